"""Best-fit packing of documents into sequences, after a reduction by dominance.

1. Documents become token ids in tasks; longer ones are cut into whole sequences and a rest. Only sizes and digests leave the task.
2. Sizes are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity`` counts, however many documents there are. It is
   all that the driver sees.
3. Reduction, sizes falling: a set with the document j is fixed for good where it dominates every other set that j can be in, that is, where the
   documents of any other such set could be exchanged one by one, or several for a larger one, against those of the fixed set:
   j alone if nothing fits beside it; j with the largest that fits, if the two fill the sequence, if only one document can
   stand beside j, or if no two that fit are larger together; j with two, if at most two can stand beside it and any other two
   are each no larger than these. A set is fixed as often as its sizes last. What is left is a smaller instance, reduced again until nothing is fixed.
4. The rest is packed by best fit, sizes falling: each document goes to the fullest sequence that holds it. Sequences with equal
   free space are one group, so a size costs a few steps and leaves at most a few groups more.
5. The plan has a row per (size, run of document numbers). Documents are numbered within their size in tasks and joined with the plan.

Defined cases: a null text is a document of its end id; repeated rows are packed as often as they occur; rows that share an id are documents
of their own; null ids are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of, written
from tallyfold.llm.pieces import LowerPieces, by_bytes, encode_column, pieces_of

CAPACITY, END_ID = 4096, 1
# Documents of a size that are numbered in one task, and that meet their part of the plan by one key.
NUMBERED, MET = 50_000, 128

Row = tuple[int, int, int, int, int, int]  # size, first number, how many, first sequence, how many in each sequence, offset


class Plan:
    """Sequences with contiguous numbers, and which documents of each size they get."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = Counter({s: n for s, n in counts.items() if n}), capacity
        self.used: Counter[int] = Counter()
        self.rows: list[Row] = []
        self.sequences = self.fixed = 0

    def put(self, size: int, first: int, sequences: int, each: int, offset: int, most: int | None = None) -> None:
        """``each`` further documents of this size in every one of the sequences, ``most`` documents in all."""
        n = each * sequences if most is None else most
        self.rows.append((size, self.used[size], n, first, each, offset))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def fix(self, content: list[int]) -> None:
        """Sequences of exactly these sizes, as often as they last."""
        needed = Counter(content)
        times = min(self.left[s] // n for s, n in needed.items())
        offset = 0
        for size, n in needed.items():
            self.put(size, self.sequences, times, n, offset)
            offset += size * n
        self.sequences += times
        self.fixed += times

    def dominating(self, j: int, sizes: list[int]) -> list[int] | None:
        """A set with j that dominates all others with j, if one of the known criteria gives it. ``sizes``: rising, those that are left."""
        room = self.capacity - j

        def amount(s: int) -> int:
            return self.left[s] - (s == j)

        def largest(limit: int, without: int = 0) -> int:
            """The largest size up to ``limit``, with ``without`` taken away once."""
            at = bisect_left(sizes, limit + 1) - 1
            while at >= 0 and amount(sizes[at]) - (sizes[at] == without) <= 0:
                at -= 1
            return sizes[at] if at >= 0 else 0

        beside = largest(room)
        if not beside:
            return [j]
        if beside == room:
            return [j, beside]
        # How many of the smallest fit beside j; more than two are not looked at.
        fit, total = 0, 0
        for s in sizes:
            n = min(amount(s), (room - total) // s, 3 - fit)
            fit, total = fit + max(n, 0), total + max(n, 0) * s
            if fit == 3 or total + s > room:
                break
        if fit == 1:
            return [j, beside]
        if fit > 2:
            return None
        # The best two: for each size the largest that fits beside it as well.
        low, high, best = 0, bisect_left(sizes, room) - 1, 0
        while low <= high:
            x, y = sizes[low], sizes[high]
            if amount(x) <= 0 or (low == high and amount(x) < 2):
                low += 1
            elif amount(y) <= 0 or x + y > room:
                high -= 1
            else:
                best = max(best, x + y)
                low += 1
        # The loop takes two different sizes; two of one size are the other case.
        best = max([best] + [2 * s for s in sizes[bisect_left(sizes, best // 2):bisect_left(sizes, room // 2 + 1)] if amount(s) >= 2])
        if beside >= best:
            return [j, beside]
        third = largest(room - beside, beside)
        if not third:
            return None
        # Two that lie between the third and the largest would not be dominated: none such may fit.
        between = []
        for s in sizes[bisect_left(sizes, third + 1):bisect_left(sizes, beside)]:
            between += [s] * min(amount(s), 2 - len(between))
            if len(between) == 2:
                break
        if len(between) < 2 or sum(between) > room:
            return [j, beside, third]
        return None

    def reduce(self) -> None:
        before = -1
        while before != self.fixed:
            before = self.fixed
            for j in sorted(self.left, reverse=True):
                while self.left.get(j) and (content := self.dominating(j, sorted(self.left))):
                    self.fix(content)

    def best_fit(self) -> None:
        groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space: (first sequence, how many)
        free: list[int] = []

        def add(space: int, first: int, many: int) -> None:
            if not groups[space]:
                insort(free, space)
            groups[space].append((first, many))

        for size in sorted(self.left, reverse=True):
            while n := self.left.get(size, 0):
                at = bisect_left(free, size)
                if at == len(free):
                    each = min(self.capacity // size, n)
                    many = n // each
                    space, first = self.capacity, self.sequences
                    self.sequences += many
                    rest = 0
                else:
                    space = free[at]
                    first, rest = groups[space].pop()
                    if not groups[space]:
                        free.pop(at)
                    each = min(space // size, n)
                    many = min(rest, n // each)
                    rest -= many
                self.put(size, first, many, each, self.capacity - space)
                if space > each * size:
                    add(space - each * size, first, many)
                if rest:
                    add(space, first + many, rest)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    made = Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made


def pieces_table(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the documents cut to at most ``capacity`` ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(LowerPieces, vocabulary)
        for part in by_bytes(batches, 1):
            sizes, ids = encode_column(pc.ascii_lower(part.column(1)), known)
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype("<i4")
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            many = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            at = (ends - sizes)[row] + start
            crc = [zlib.crc32(ids[a:a + n]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _numbered(pieces: DataFrame) -> DataFrame:
    """With ``number``: 0, 1, … within each length. A length is numbered in parts, so one that a third of all rows have is no task of its own."""
    parts = max(pieces.count() // NUMBERED, 1)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("inside", inside).join(before, ["length", "part"]).select(*pieces.columns, (F.col("ahead") + F.col("inside")).alias("number"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``fixed``: whether the sequence was fixed by dominance."""
    spark = docs.sparkSession
    pieces = written(pieces_table(docs, vocabulary, capacity, end_id), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    columns = ["length", "first", "many", "sequence", "each", "at"]
    rows = written(spark.createDataFrame(pd.DataFrame(made.rows, columns=columns, dtype="int64"), ", ".join(f"{c} long" for c in columns)), "pack-plan")
    # A run of numbers is met by the keys of all stretches that it covers.
    stretches = F.sequence(F.floor(F.col("first") / MET), F.floor((F.col("first") + F.col("many") - 1) / MET))
    placed = rows.withColumn("stretch", F.explode(stretches))
    numbered = written(_numbered(pieces), "pack-numbered").withColumn("stretch", F.floor(F.col("number") / MET))
    met = numbered.join(placed, ["length", "stretch"]).where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("many")))
    turn = F.col("number") - F.col("first")
    sequence = F.col("sequence") + F.floor(turn / F.col("each"))
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"),
        (F.col("at") + turn % F.col("each") * F.col("length")).alias("offset"), (sequence < made.fixed).alias("fixed"))
