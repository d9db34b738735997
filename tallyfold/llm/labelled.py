"""Bounded labelled samples, and texts scored by a trained model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of
from tallyfold.llm.subword import bag_scores

PREDICTED_FROM = 0.7
MAX_TRAINING_BYTES = 1 << 16  # a longer text is left out of the training sample; it is scored whole like any other


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, seen: Column, rows: int) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts, picked by a hash of their id. Ids with contradicting labels are not used."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & seen)
    sure = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where(F.col("label") == F.col("other")).drop("other")
    picked = sure.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)
    # At most ``rows`` rows of two numbers: a bound that does not depend on the tables.
    texts = docs.select("doc_id", text_of("text").alias("text")).where(F.octet_length("text") <= MAX_TRAINING_BYTES).join(F.broadcast(picked), "doc_id")
    got = texts.orderBy("doc_id", "text").limit(rows).collect()
    return [r["text"] for r in got], np.array([r["label"] for r in got], np.int64)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], fold: bool, window: int | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; ``docs`` has doc_id, text and held_out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                score = bag_scores(part.column(1).to_pylist(), model, fold, window)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score), pa.array((score >= PREDICTED_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
