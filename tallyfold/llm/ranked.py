"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time.

1. Items are taken in blocks of bounded size; their terms are the block's vocabulary.
2. One pass over the documents cuts them into terms and writes, per document, its length and the frequencies of the block's terms. Numbers of
   documents and terms and the document frequencies are sums over all documents.
3. The index is dealt by documents: a task inverts a bounded run of documents at a time into lists per term, and keeps
   the best k of each item so far, whose worst score is the item's floor from run to run. For an item and a run,
   * short lists are read term at a time: their scores are added up in accumulators, which are then one list like any other, with its bound;
   * long lists are not added up. Lists are ordered by their bounds, and those that cannot reach the floor together are only looked up, never read. Candidates come in
     order of documents from the others, in stretches; a candidate is followed through the looked-up lists only while its score and the bounds to
     come can reach the floor, which rises after each stretch.
4. The best k of every task are ranked once more.

Scores are whole numbers, so sums do not depend on their order.

Defined cases: null, empty and wordless texts have no terms and are no documents of the statistics; an item without terms, or whose terms no document
has, gives no rows; rows that share an id are documents or items of their own, and equal scores go by ``doc_id``, null ids last; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyfold.llm.common import text_of, written
from tallyfold.llm.pieces import by_bytes

TOP = 10
# A block of items: so many, or with so many terms between them. Every block is a pass over the documents.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 250_000
# Postings that a task inverts at a time, and the share of a run's documents up to which a list is short.
RUN_POSTINGS, RUN_DOCUMENTS, SHORT = 1_000_000, 65_536, 1 / 32
# Candidates that are followed at a time: few at first, as the floor is still low.
STRETCHES = (256, 1024, 4096)

# Bytes of terms: digits, letters and everything beyond ASCII; only A-Z are lowered.
_TERM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


def _items(items: DataFrame) -> DataFrame:
    """item_id and distinct terms of every item that has some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1):
            terms = [sorted(set(terms_of(t))) for t in part.column(1).to_pylist()]
            batch = pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])
            yield batch.filter(pa.array(list(map(bool, terms)), pa.bool_()))

    return items.select(F.col("item_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, "item_id long, terms array<binary>")


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n and, sorted, the block's terms with their frequencies, of every document with terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1):
            sizes, lists, times = [], [], []
            for text in part.column(1).to_pylist():
                found = terms_of(text)
                sizes.append(len(found))
                known, many = np.unique(np.fromiter((t for t in map(vocabulary.get, found) if t is not None), np.int32), return_counts=True)
                lists.append(known)
                times.append(many)
            offsets = pa.array(np.concatenate(([0], np.cumsum(list(map(len, lists))))).astype(np.int32))
            flat = [pa.array(np.concatenate(x).astype(np.int32)) for x in (lists, times)]
            batch = pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(offsets, x) for x in flat)], names=["doc_id", "n", "terms", "times"])
            yield batch.filter(pa.array(np.array(sizes) > 0))

    return docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


class Best:
    """The best k documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``ids``: whether the id is null, and the id."""
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids[:, 1], ids[:, 0], -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])  # an equal score may still win by its id


def _looked_up(docs: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted documents in one list, 0 where it lacks them. Both are sorted."""
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, values[at], 0)


def search_run(lists: list[tuple[np.ndarray, np.ndarray, int]], n: int, ids: np.ndarray, best: Best, short: float = SHORT) -> int:
    """Take the best of documents 0 … n - 1 for one item; gives the number of list entries that were read.

    ``lists`` are, per term, sorted document numbers, their scores and the highest of these.
    """
    brief = [x for x in lists if len(x[0]) <= short * n]
    kept = [x for x in lists if len(x[0]) > short * n]
    read = sum(len(x[0]) for x in brief)
    if brief:
        sums = np.zeros(n, np.int64)
        np.add.at(sums, np.concatenate([x[0] for x in brief]), np.concatenate([x[1] for x in brief]))
        held = np.flatnonzero(sums)
        if len(held):
            kept.append((held, sums[held], int(sums.max())))
    bounds = np.array([top for _, _, top in kept], np.int64)
    order = np.argsort(bounds, kind="stable")
    kept, bounds = [kept[i][:2] for i in order], bounds[order]
    reach = np.cumsum(bounds)  # what the lists up to one can give together
    at, turn = 0, 0
    while at < n:
        first = int(np.searchsorted(reach, best.floor))  # lists before it cannot reach the floor by themselves
        if first == len(kept):
            break
        # The next stretch of documents: as many as the lists that are read need for their share of candidates.
        want, turn = STRETCHES[min(turn, len(STRETCHES) - 1)], turn + 1
        starts = [int(np.searchsorted(d, at)) for d, _ in kept[first:]]
        ahead = [int(d[min(lo + want, len(d)) - 1]) + 1 for (d, _), lo in zip(kept[first:], starts) if lo < len(d)]
        if not ahead:
            break
        end = min(ahead)
        sums = np.zeros(end - at, np.int64)
        for (d, s), lo in zip(kept[first:], starts):
            hi = lo + int(np.searchsorted(d[lo:lo + end - at], end))
            sums[d[lo:hi] - at] += s[lo:hi]
            read += hi - lo
        wanted = np.flatnonzero(sums)
        scores = sums[wanted]
        for i in range(first - 1, -1, -1):
            alive = scores + reach[i] >= best.floor
            wanted, scores = wanted[alive], scores[alive]
            if not len(wanted):
                break
            scores = scores + _looked_up(*kept[i], wanted + at)
            read += len(wanted)
        reached = scores >= best.floor
        if reached.any():
            best.take(scores[reached], ids[wanted[reached] + at])
        at = end
    return read


def _searched(postings: DataFrame, items: list[np.ndarray], weights: np.ndarray, count: int, length: int, k: int) -> DataFrame:
    """item, doc_id, score: the best k of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        held: list[pa.RecordBatch] = []

        def searched() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            n = table.num_rows
            many = np.diff(table["terms"].chunk(0).offsets.to_numpy())
            terms, times = (table[c].chunk(0).flatten().to_numpy() for c in ("terms", "times"))
            norm = 100 - 90 + 90 * table["n"].to_numpy() * count // length
            missing = table["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = np.stack((missing.astype(np.int64), table["doc_id"].fill_null(0).to_numpy()), axis=1)
            docs = np.repeat(np.arange(n, dtype=np.int32), many)
            tf = times.astype(np.int64)
            scores = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[docs]))
            order = np.argsort(terms, kind="stable")
            terms, docs, scores = terms[order], docs[order], scores[order]
            cuts = np.searchsorted(terms, np.arange(len(weights) + 1))
            tops = np.zeros(len(weights), np.int64)
            there = np.flatnonzero(np.diff(cuts))
            tops[there] = np.maximum.reduceat(scores, cuts[there]) if len(there) else 0
            for b, wanted in zip(best, items):
                lists = [(docs[lo:hi], scores[lo:hi], top) for lo, hi, top in zip(cuts[wanted], cuts[wanted + 1], tops[wanted]) if top > 0]
                if lists:
                    search_run(lists, n, ids, b)

        size = rows = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                held.append(part)
                size, rows = size + len(part.column(2).flatten()), rows + part.num_rows
                if size >= RUN_POSTINGS or rows >= RUN_DOCUMENTS:
                    searched()
                    size = rows = 0
        if held:
            searched()
        for number, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.scores), number)), pa.array(b.ids[:, 1], mask=b.ids[:, 0] == 1), pa.array(b.scores)], names=["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item long, doc_id long, score long")


def _searched_block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """item_id, rank, doc_id, score of a block of items (id and terms)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    postings = written(_postings(docs, vocabulary), "search-postings")
    total = postings.agg(F.count("*").alias("count"), F.sum("n").alias("length")).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        frequency[r["term"]] = r["df"]
    count, length = total["count"], total["length"] or 0
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    items = [np.array(sorted(vocabulary[t] for t in terms), np.int64) for _, terms in block]
    found = _searched(postings, items, weights, count, max(length, 1), k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    kept = found.withColumn("rank", rank).where(F.col("rank") <= k)
    schema = StructType([StructField("item", LongType()), StructField("item_id", LongType())])
    names = spark.createDataFrame([Row(i, name) for i, (name, _) in enumerate(block)], schema)
    return kept.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item. ``docs`` has doc_id and text, ``items`` item_id and text."""
    parts, block, size = [], [], 0
    for row in _items(items).toLocalIterator():
        terms = {bytes(t) for t in row["terms"]}
        if block and (len(block) == BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
            parts.append(written(_searched_block(docs, block, k), "search-block"))
            block, size = [], 0
        block.append((row["item_id"], terms))
        size += len(terms)
    if block or not parts:
        parts.append(_searched_block(docs, block, k))
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made
