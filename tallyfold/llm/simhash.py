"""SimHash near-duplicates with pigeonring filtering.

1. Every document gets a 64-bit fingerprint of its word shingles; equal fingerprints are one class from here on.
2. Pigeonring: split 64 bits into 4 segments in a ring. Two fingerprints within 3 bits have a segment from which every chain of
   l consecutive segments differs in at most l·3/4 bits: 0, then 1, 2, 3. So for that segment the bits are equal, one
   half of the next segment is equal (at most 1 bit differs in it), and one third of the one after that (at most 2 bits differ up to there).
   Class representatives meet by these 4 · 2 · 3 keys of 29 or 30 bits.
3. Where they meet, chains are checked segment by segment and only then the whole distance. A task keeps the links that join
   something new (a spanning forest of the key's links), so a dense group of n gives n - 1 links, not n².
4. Connected components of the links, joined back to the documents.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked like any other; fewer words than
a shingle make one shingle; ``component_id`` is the smallest non-null ``doc_id`` reachable; repeated rows are documents of their own; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import near_copies
from tallyfold.llm.common import written
from tallyfold.llm.components import components
from tallyfold.llm.repeats import maybe_in

SEED = 42
SHINGLE_WORDS = 3
SEGMENTS, WIDTH, DISTANCE = 4, 16, 3
# Bits of each half and each third within a segment.
HALVES, THIRDS = ((0, 8), (8, 8)), ((0, 6), (6, 5), (11, 5))
_COUNTED = 1 << 15  # shingles whose bits are counted at a time


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Bit b is set if it is set in more than half of the shingles' hashes."""
    tokens = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = ends - np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1
    lo = starts[: max(len(tokens) - words + 1, 1)].tolist()
    hi = (ends[min(words, len(tokens)) - 1:] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return majority(np.fromiter((hashed(line[a:b], SEED) for a, b in zip(lo, hi)), "<u8", len(lo)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, _COUNTED):
        h = hashes[at:at + _COUNTED].astype("<u8", copy=False)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer, of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py() or "", words) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view("<i8"))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def chain_keys(fp: Column) -> Column:
    """The 24 chain keys of a fingerprint; their low 5 bits name the segment, the half and the third."""
    def bits(segment: int, start: int, width: int) -> Column:
        return F.shiftrightunsigned(fp, (segment % SEGMENTS) * WIDTH + start).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for s in range(SEGMENTS):
        for h, (at, width) in enumerate(HALVES):
            for t, (at2, width2) in enumerate(THIRDS):
                value = F.shiftleft(F.shiftleft(bits(s, 0, WIDTH), width).bitwiseOR(bits(s + 1, at, width)), width2).bitwiseOR(bits(s + 2, at2, width2))
                keys.append(F.shiftleft(value, 5).bitwiseOR(F.lit((s * 2 + h) * 3 + t)))
    return F.array(*keys)


def _within(x: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Whether chains from ``segment`` stay within their budgets: cumulative differences of at most l·3/4 bits."""
    turn = segment.astype(np.uint64) * np.uint64(WIDTH)
    ring = np.where(turn == 0, x, (x >> turn) | (x << ((np.uint64(64) - turn) & np.uint64(63))))
    alive = np.arange(len(x))
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (WIDTH * length)) - 1)
        alive = alive[np.bitwise_count(ring[alive] & mask) <= length * DISTANCE // SEGMENTS]
    ok = np.zeros(len(x), bool)
    ok[alive] = True
    return ok


def _forest(key: np.ndarray, fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Links within groups of equal keys (sorted) that join something new, as row pairs."""
    n = len(key)
    _, first, sizes = np.unique(key, return_index=True, return_counts=True)
    ends = np.repeat(first + sizes, sizes)
    segment = (key & 31) // 6
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    left, right, rows, shift = [], [], np.arange(n), 1
    while True:
        rows = rows[rows + shift < ends[rows]]
        if not len(rows):
            return left, right
        near = rows[_within(fp[rows] ^ fp[rows + shift], segment[rows])]
        near = near[root[near] != root[near + shift]]
        for i in near.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + shift)
        for _ in range(2):
            root = root[root]
        shift += 1


def links(classes: DataFrame) -> DataFrame:
    """u, v: links between different fingerprints whose components are those of all pairs within the distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0

        def flush(last: bool):
            nonlocal keys, fps, held
            if not held:
                return None
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = len(k) if last else int(np.searchsorted(k, k[-1]))  # the last key may go on
            keys, fps, held = [k[cut:]], [f[cut:]], len(k) - cut
            a, b = _forest(k[:cut], f[:cut].view("<u8"))
            return pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], names=["u", "v"]) if a else None

        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            fps.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= 1 << 18 and (made := flush(False)) is not None:
                yield made
        if (made := flush(True)) is not None:
            yield made

    rows = classes.select(F.explode(chain_keys(F.col("fp"))).alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    marked = written(fingerprints(docs, words), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    found = components(links(classes)).withColumnRenamed("node", "fp")
    rooted = classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def chained_pairs(prints: DataFrame) -> DataFrame:
    """u, v: pairs of names that (name, fp) proposes: each with the first of its fingerprint, and those firsts along the chains' forests."""
    classes = written(prints.groupBy("fp").agg(F.min("name").alias("first")), "copies-prints")
    equal = prints.join(classes, "fp").where(F.col("name") != F.col("first")).select(F.col("name").alias("a"), F.col("first").alias("b"))
    one, two = classes.select(F.col("fp").alias("u"), F.col("first").alias("a")), classes.select(F.col("fp").alias("v"), F.col("first").alias("b"))
    near = links(classes).join(one, "u").join(two, "v").select("a", "b")
    return equal.unionByName(near).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def keep_one(docs: DataFrame, words: int = near_copies.WORDS, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """One row of each group of near copies, the first of it; all columns stay.

    No contract fixes bits here: near copies are texts whose word shingles have at least this Jaccard similarity. Fingerprints and their chains
    propose the closest pairs; those whose fingerprints are further apart meet by minimum hashes.
    Rows are told apart by text and id: of different texts that share an id each is judged by itself, and of rows with both alike one stays.
    """
    grouped = near_copies.groups(docs, majority, chained_pairs, words, similarity)
    first = written(near_copies.first_of(grouped), "copies-first")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return (a["name"] == b["name"]) & a["doc_id"].eqNullSafe(b["doc_id"])

    dropped = written(grouped.join(first, same(grouped, first), "left_anti").select("name", "doc_id"), "near-copies")
    # Most rows stay: only those whose id may be among the dropped ones are shuffled, with their texts.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), F.xxhash64(docs["doc_id"]).alias("d1"))
    name = near_copies.name_of(F.col("row.text"))
    perhaps, stays = maybe_in(rows, dropped.select(F.xxhash64("doc_id").alias("d1")))
    gone = (F.col("held") == F.col("name")) & F.col("id").eqNullSafe(F.col("doc_id"))
    kept = perhaps.withColumn("held", name).join(dropped, gone, "left_anti").drop("held").unionByName(stays)
    repeated = first.where(F.col("n") > 1)
    if repeated.isEmpty():
        return kept.select("row.*")
    several = repeated.select(F.col("name").alias("held"))
    perhaps, single = maybe_in(kept, repeated.select(F.xxhash64("doc_id").alias("d1")))
    held = perhaps.withColumn("held", name)
    one = held.join(several, "held", "left_semi").dropDuplicates(["held"])
    return held.join(several, "held", "left_anti").unionByName(one).drop("held").unionByName(single).select("row.*")
