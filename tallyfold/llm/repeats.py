"""Exact removal of repeated byte strings by suffix sorting.

A byte goes if a string of 400 bytes that covers it also starts anywhere else, in the same document or another one. Sorting all
suffixes of a corpus would move every suffix's text; here hashes first find the few places that have to be sorted.

1. Every window of 400 bytes has a minimizer, its 64-byte gram with the smallest hash (leftmost on ties). Equal windows have equal minimizers at equal
   offsets, and the windows of one minimizer are a run. So a document becomes one anchor row per run: gram, digest of the
   run's whole text, place. A gram that occurs once ends there.
2. A run whose whole text occurs at least twice is repeated as a whole. What is left are runs that share a gram and differ somewhere.
3. Those are cut into groups of 32 windows at fixed offsets from the gram. All 32 share a core of 369 bytes; only 31 bytes before and behind
   it tell them apart. Cores that occur once end there; equal cores with equal margins are repeated as a whole.
4. The remaining strings - margin, core as one symbol, margin - are suffix sorted in their core's task: suffixes that are smaller than their
   successors are sorted, the others induced by a bucket scan. Neighbours with a common prefix of 32 symbols are windows of 400 equal bytes.
5. Repeated windows are merged per text and cut out.

Texts are known by a 128-bit digest, so copies of a text share their spans. Groups are counted with partial aggregation, and
the sorting tasks get each distinct string once; core groups above ``GROUP_ROWS`` strings are halved into groups of fewer windows, down to single windows, which need no
sorting. Texts are moved only for documents that may have something to sort or cut, told by a bit table of fixed size.

Defined cases: a null text is empty; texts below 400 bytes keep everything and repeat nothing; repeated rows are documents of their own; a null
``doc_id`` is carried; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of, written
from tallyfold.llm.suffix import common_prefixes, suffix_array

LENGTH, GRAM, STEP = 400, 64, 32
GROUP_ROWS = 50_000
_CHUNK = 1 << 20
_BIT_WORDS = 1 << 17  # 64-bit words of the bit table: 1 MB whatever the corpus
_SYMBOLS = 1 << 17  # sorted at a time

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        size = _CHUNK + LENGTH
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _powers[name] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))))
    return _powers["up"], _powers["down"]


def runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Gram hash, place of the minimizer, first and last window of every run of windows with one minimizer."""
    up, down = _power_tables()
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        part = data[at:at + _CHUNK + LENGTH - 1]
        n = len(part)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[part] * up[:n], dtype=np.uint64)))
        gram = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(32)
        key = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(len(gram), dtype=np.uint64)
        width, have = LENGTH - GRAM + 1, 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have:])
        where = (key & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        last = np.append(first[1:], len(where)) - 1
        yield gram[where[first]].view(np.int64), where[first] + at, first + at, last + at


def digest() -> list[Column]:
    """Two 64-bit hashes of the text, together its name."""
    return [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(9), "text").alias("d2")]


def anchors(texts: DataFrame) -> DataFrame:
    """gram, whole (hash of the run's text), d1, d2, place, lo, hi of every run; ``texts`` has text, d1, d2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "whole", "d1", "d2", "place", "lo", "hi"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            d1, d2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for row, text in enumerate(batch.column(0)):
                data = text.as_py().encode()
                for gram, place, lo, hi in runs(np.frombuffer(data, np.uint8)):
                    whole = np.array([xxhash.xxh3_64_intdigest(data[a:b + LENGTH], p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), place.tolist())], np.uint64).view(np.int64)
                    for store, values in zip(out, (gram, whole, np.full(len(gram), d1[row]), np.full(len(gram), d2[row]), place, lo, hi)):
                        store.append(values)
                    held += len(gram)
                    if held >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)
                        out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    long_enough = texts.where(F.octet_length("text") >= LENGTH).select("text", "d1", "d2")
    return long_enough.mapInArrow(run, "gram long, whole long, d1 long, d2 long, place long, lo long, hi long")


def maybe_in(texts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts whose name is in ``names``, and perhaps a few more, and all others, by a bit table of fixed size."""
    word = F.pmod(F.shiftright("d1", 6), F.lit(_BIT_WORDS)).cast("int")
    bits = names.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(d1 & 63 AS INT))")).alias("bits"))
    marked = texts.withColumn("word", word).join(F.broadcast(written(bits, "repeat-bits")), "word", "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(bits, CAST(d1 & 63 AS INT)) & 1) = 1"), F.lit(False))
    return marked.where(hit).drop("word", "bits"), marked.where(~hit).drop("word", "bits")


def pieces(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The groups of ``STEP`` windows of the needed runs: core, left, right, d1, d2, at (place of the core), many.

    A group's margins end with the windows of its own run, so every window is in one piece only: runs whose places agree modulo ``STEP`` meet at one core.
    ``needed`` has d1, d2, place, lo, hi and many (whether the run's whole text occurs more than once).
    """
    lists = written(needed.groupBy("d1", "d2").agg(F.collect_list(F.struct("place", "lo", "hi", "many")).alias("runs")), "repeat-lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "head", "tail", "d1", "d2", "at", "many"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, d1, d2, listed in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for x in listed:
                    near, far = (x["place"] - x["hi"]) // STEP, (x["place"] - x["lo"]) // STEP
                    for group in range(near, far + 1):
                        at = x["place"] - group * STEP
                        stop = at + LENGTH - STEP + 1
                        head, tail = data[max(at - STEP + 1, x["lo"]):at], data[stop:min(stop + STEP - 1, x["hi"] + LENGTH)]
                        row = (xxhash.xxh3_128_digest(data[at:stop]), head, tail, d1, d2, at, x["many"])
                        for store, value in zip(out, row):
                            store.append(value)
                if len(out[0]) >= 1 << 14:
                    yield _piece_batch(out, names)
                    out = [[] for _ in names]
            if out[0]:
                yield _piece_batch(out, names)

    kept, _ = maybe_in(texts, needed)
    return kept.join(lists, ["d1", "d2"]).select("text", "d1", "d2", "runs").mapInArrow(run, "core binary, head binary, tail binary, d1 long, d2 long, at long, many boolean")


def _piece_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)


def repeated_windows(cores: list, left: list[bytes], right: list[bytes], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and number (of ``step``) of every window that another row's window equals. Rows of one core are adjacent and distinct.

    A row is written as ``2 * step`` symbols: margin, core, margin, end. A window is ``step`` symbols from one of the first ``step`` on.
    """
    n, margin = len(cores), step - 1
    table = np.zeros((n, 2 * step), np.int64)
    for i, (a, b) in enumerate(zip(left, right)):
        table[i, margin - len(a):margin] = np.frombuffer(a, np.uint8)
        table[i, margin + 1:margin + 1 + len(b)] = np.frombuffer(b, np.uint8)
    real = np.zeros(table.shape, bool)
    for i, (a, b) in enumerate(zip(left, right)):
        real[i, margin - len(a):margin + 1 + len(b)] = True
    table[:, :-1] += 1
    table *= real
    change = np.append(True, np.array([x != y for x, y in zip(cores[1:], cores[:-1])], bool)) if n else np.zeros(0, bool)
    table[:, margin] = 257 + np.cumsum(change)
    text = table.ravel()
    order = suffix_array(text, step)
    same = common_prefixes(text, order, step) >= step
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    hit[order[np.append(same[1:], False)]] = True
    # Only windows that lie within the text count.
    inside = np.lib.stride_tricks.sliding_window_view(real, step, axis=1).all(axis=2)[:, :step]
    return np.nonzero(hit.reshape(n, -1)[:, :step] & inside)


def _sorted_spans(strings: DataFrame, step: int) -> DataFrame:
    """d1, d2, lo, hi: windows of strings that occur once whose 400 bytes another string of the core has too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def spans(part: list[tuple]) -> pa.RecordBatch | None:
            row, number = repeated_windows([r[0] for r in part], [r[1] for r in part], [r[2] for r in part], step)
            keep = np.array([not r[6] for r in part], bool)[row] if len(row) else np.zeros(0, bool)
            row, number = row[keep], number[keep]
            if not len(row):
                return None
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)))
            last = np.append(first[1:], len(row)) - 1
            base = np.array([r[5] for r in part], np.int64)[row[first]] - (step - 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array([part[i][3] for i in row[first]], np.int64)), pa.array(np.array([part[i][4] for i in row[first]], np.int64)), pa.array(base + number[first]), pa.array(base + number[last] + LENGTH)],
                names=["d1", "d2", "lo", "hi"])

        for batch in batches:
            rows += list(zip(*(c.to_pylist() for c in batch.columns)))
            while len(rows) * 2 * step >= _SYMBOLS:
                cut = min(len(rows), _SYMBOLS // (2 * step))
                while cut < len(rows) and rows[cut][0] == rows[cut - 1][0]:
                    cut += 1
                if cut == len(rows):
                    break  # the last core may go on
                if (made := spans(rows[:cut])) is not None:
                    yield made
                rows = rows[cut:]
        if rows and (made := spans(rows)) is not None:
            yield made

    ordered = strings.select("core", "head", "tail", "d1", "d2", "at", "many").repartition("core").sortWithinPartitions("core", "head", "tail")
    return ordered.mapInArrow(run, "d1 long, d2 long, lo long, hi long")


def _halved(strings: DataFrame, step: int) -> DataFrame:
    """Groups of ``step`` windows as two groups of half as many: the inner halves of the margins join the core."""
    half = step // 2
    own_left = F.expr(f"substring(head, greatest(length(head) - {half - 1} + 1, 1), least(length(head), {half - 1}))")
    later = strings.where(F.length("tail") >= half).select(
        F.unhex(F.md5(F.concat("core", F.lit(b"R"), F.expr(f"substring(tail, 1, {half})")))).alias("core"), own_left.alias("head"),
        F.expr(f"substring(tail, {half} + 1, {half - 1})").alias("tail"), "d1", "d2", "at", "many")
    sooner = strings.where(F.length("head") >= half).select(
        F.unhex(F.md5(F.concat("core", F.lit(b"L"), F.expr(f"substring(head, length(head) - {half} + 1, {half})")))).alias("core"),
        F.expr(f"substring(head, greatest(length(head) - {step - 1} + 1, 1), length(head) - {half})").alias("head"),
        F.expr(f"substring(tail, 1, {half - 1})").alias("tail"), "d1", "d2", (F.col("at") - half).alias("at"), "many")
    return later.unionByName(sooner)


def _piece_spans(found: DataFrame, step: int = STEP) -> list[DataFrame]:
    """Spans of repeated windows among pieces: whole pieces by counting, the others by sorting."""
    out = []
    while True:
        distinct = written(found.groupBy("core", "head", "tail").agg(
            F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n"), F.min(F.struct("d1", "d2", "at")).alias("one")), "repeat-strings")
        often = distinct.where(F.col("n") > 1).select("core", "head", "tail")
        matched = found.where(~F.col("many")).join(often, ["core", "head", "tail"])
        out.append(matched.select("d1", "d2", (F.col("at") - F.length("head")).alias("lo"), (F.col("at") + F.length("tail") + LENGTH - step + 1).alias("hi")))
        if step == 1:
            return out
        groups = written(distinct.groupBy("core").agg(F.count("*").alias("strings"), F.min("n").alias("least")).where((F.col("strings") > 1) & (F.col("least") == 1)), "repeat-cores")
        left = written(distinct.join(groups, "core").select("core", "head", "tail", "one.*", (F.col("n") > 1).alias("many"), "strings"), "repeat-groups")
        out.append(_sorted_spans(left.where(F.col("strings") <= GROUP_ROWS), step))
        large = left.where(F.col("strings") > GROUP_ROWS).drop("strings")
        if large.isEmpty():
            return out
        found, step = written(_halved(large, step), "repeat-pieces"), step // 2


def repeated_spans(texts: DataFrame) -> DataFrame:
    """d1, d2, lo, hi: byte spans, perhaps overlapping, whose union are the repeated bytes of each text. ``texts`` has text, d1, d2."""
    rows = written(anchors(texts), "repeat-anchors")
    # Facts that a large table is joined with are written first: both sides are then dealt out for the join, and a hot key can be split.
    shared = written(rows.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gram"), "repeat-grams")
    met = written(rows.join(shared, "gram"), "repeat-shared")
    wholes = written(met.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "place", "lo", "hi")).alias("one")), "repeat-wholes")
    often = wholes.where(F.col("n") > 1)
    whole_spans = met.join(often.select("gram", "whole"), ["gram", "whole"]).select("d1", "d2", "lo", (F.col("hi") + LENGTH).alias("hi"))
    open_grams = written(wholes.groupBy("gram").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where((F.col("least") == 1) & (F.col("kinds") > 1)).select("gram"), "repeat-open")
    needed = written(wholes.join(open_grams, "gram").select("one.*", (F.col("n") > 1).alias("many")), "repeat-needed")
    found = written(pieces(texts, needed), "repeat-pieces")
    spans = whole_spans
    for more in _piece_spans(found):
        spans = spans.unionByName(more)
    return spans


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes of every document."""
    texts = docs.select("doc_id", text_of("text").alias("text")).select("doc_id", "text", *digest())
    merged = written(repeated_spans(texts).distinct().groupBy("d1", "d2").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "repeat-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                kept, at, removed, count, end = [], 0, 0, 0, -1
                for s in spans or ():
                    lo, hi = max(s["lo"], at), s["hi"]
                    if s["lo"] > end:
                        count += 1
                    end = max(end, hi)
                    if hi > at:
                        kept.append(data[at:lo])
                        removed += hi - lo
                        at = hi
                kept.append(data[at:])
                left = b"".join(kept)
                for store, value in zip(out, (doc_id, len(data), removed, count, hashlib.sha256(left).hexdigest(), left if with_bytes else None)):
                    store.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    cut, plain = maybe_in(texts, merged)
    with_spans = cut.join(merged, ["d1", "d2"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    data, none = F.col("text").cast("binary"), F.lit(0).cast("bigint")
    whole = plain.select("doc_id", F.length(data).cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), data.alias("kept"))
    made = with_spans.unionByName(whole)
    return made if with_bytes else made.drop("kept")
