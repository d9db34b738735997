"""Token ids as ORC files that can be pruned by document.

Documents are dealt to tasks by ranges of ``doc_id`` and sorted, so file k holds smaller ids than file k + 1. Each row is one
document: doc_id, n_tokens, ids. ORC writes integers in run-length encoding, keeps minimum and maximum per
stripe and per row group, and gets a Bloom filter on ``doc_id``; a reader that looks for a document skips files, stripes and row groups.

Tokenizing is done after the documents were dealt out, in the task that writes them. Texts are cut at
single spaces: a piece that begins with a space is encoded by itself to the same ids as within its text, unless two
spaces meet. So pieces are encoded once and remembered in a bounded table per worker; a text with two spaces in a row is encoded whole.

Defined cases: a null text has no ids besides the end id; null ids come first; rows that share a ``doc_id`` are
ordered by their text; repeated rows are written as often as they occur; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of
from tallyfold.llm.pieces import TABLE_BYTES, TEXT_BYTES, SpacedPieces, by_bytes, encode_column, forget_pieces, pieces_of
from tallyfold.session import scratch_path

END_ID = 0
STRIPE_BYTES = 32 << 20
ROW_GROUP = 1_000


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, table_bytes: int = TABLE_BYTES, text_bytes: int = TEXT_BYTES) -> None:
    """Write the documents' ids below ``path``. ``vocabulary`` is a file of the tokenizers library that every executor has.

    ``table_bytes`` and ``text_bytes`` bound what a worker remembers and what it encodes at a time; they change the speed only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(SpacedPieces, vocabulary, table_bytes)
        for part in by_bytes(batches, 1, text_bytes):
            sizes, ids = encode_column(part.column(1), known)
            ends = np.cumsum(sizes)
            closed = pa.array(np.insert(ids, ends, end_id))
            offsets = pa.array(np.concatenate(([0], ends + np.arange(1, len(ends) + 1))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes + 1), pa.ListArray.from_arrays(offsets, closed)], names=["doc_id", "n_tokens", "ids"])

    dealt = docs.select("doc_id", text_of("text").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = dealt.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")
    (rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(path))


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every written document; ``start`` counts the ids of all documents before it.

    Files are in order of their ids, and rows within a file too: a document's start is the sum of the files
    before its own, one row per file, and of the rows before it in the file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()  # a worker that has written before needs its table no longer
        for batch in batches:
            ids = batch.column(2)
            flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            n = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(crc, pa.int64()), batch.column(3)], names=["file", "doc_id", "n_tokens", "ids_crc32", "place"])

    stored = spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)
    # Rows that share an id keep the order of the scan.
    read = stored.select(F.input_file_name().alias("file"), "doc_id", "ids", F.monotonically_increasing_id().alias("place")).mapInArrow(
        run, "file string, doc_id long, n_tokens long, ids_crc32 long, place long")
    sizes = spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path).groupBy(F.input_file_name().alias("file")).agg(F.sum("n_tokens").alias("ids_in_file"))
    starts = sizes.select("file", F.coalesce(F.sum("ids_in_file").over(Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, vocabulary: str, table_bytes: int = TABLE_BYTES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and describe what was read back from the files."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, END_ID, table_bytes, text_bytes)
    return read_tokens(docs.sparkSession, path)
