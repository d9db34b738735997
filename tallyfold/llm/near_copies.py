"""Near copies by the Jaccard similarity of word shingles.

1. Every distinct text gets a fingerprint and 160 minimum hashes of its shingles, joined four by four to 40 keys. Texts of similarity s share no key with
   probability (1 - s⁴)⁴⁰: 7e-10 at 0.8, less above. (Fingerprints of 64 bits differ in about 10 bits there, too many for chain budgets.)
2. The closest texts meet first: those of equal fingerprints, and the forests of the pigeonring chains of ``simhash``. What is left of a group meets by keys.
   All pairs are confirmed by their whole shingle sets. By keys each text first meets one representative per key, so a dense group
   of n costs n pairs a key; then the pairs of one key that are not yet in one component are held against each other as bit maps of their sets. A bit
   that only one of two has is a shingle that only one has, so the maps bound the similarity from above; only pairs that reach it are made.
3. Pairs are confirmed in tiles: texts that met lie in one home, a large home is halved by the names' hash until its sets fit a task, and a set is sent
   once to each pair of homes that needs it, not once per pair.
4. Connected components of the confirmed pairs, joined back to the documents.

Words are those of the fingerprints. Fewer words than a shingle make one shingle.

Defined cases: a null text is empty; texts without words are copies of each other; equal texts are copies, also where they share an id or have
none; the first of a group is the one with the smallest id, null ids last; very long texts are taken whole, their shingles a stretch at a time; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of, written
from tallyfold.llm.components import components
from tallyfold.llm.repeats import maybe_in

SEED = 42
WORDS, SIMILARITY = 5, 0.8
KEYS, IN_KEY = 40, 4
SPARSE_ROUNDS = 1
_HASHED = 1 << 11  # shingles that meet all hash functions at a time
_PAIRS = 1 << 16
HOME_BYTES = 4 << 20  # sets of a home
KEY_ROWS = 2048  # members of a key that one task compares
MAP_BITS = 9, 14  # a map has 8 bits a shingle, in powers of two from 2^9 to 2^14

_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(0, 1 << 64, (KEYS * IN_KEY, 1), dtype=np.uint64) | np.uint64(1)
_MASKS = _rng.integers(0, 1 << 64, (KEYS * IN_KEY, 1), dtype=np.uint64)


def hashed_shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The 64-bit hashes of the word shingles, repeats included."""
    tokens = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not tokens:
        return np.zeros(0, np.uint64)
    line, sizes = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    lo, hi = (ends - sizes)[: max(len(tokens) - words + 1, 1)].tolist(), ends[min(words, len(tokens)) - 1:].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(lo, hi)), np.uint64, len(lo))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    return np.unique(hashed_shingles(text, words))


def keys_of(found: np.ndarray) -> list[int]:
    """The keys of a shingle set."""
    least = np.full(KEYS * IN_KEY, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _HASHED):
        least = np.minimum(least, ((found[at:at + _HASHED] ^ _MASKS) * _FACTORS).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), no) for no, part in enumerate(least.reshape(KEYS, IN_KEY))]


def _sketches(texts: DataFrame, words: int, print_of: Callable[[np.ndarray], int]) -> DataFrame:
    """name, n (different shingles), fp (fingerprint) and keys of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for text in batch.column(1):
                every = hashed_shingles(text.as_py(), words)
                different = np.unique(every)
                sizes.append(len(different))
                prints.append(print_of(every))
                keys.append(keys_of(different))
            flat = np.array(keys, np.uint64).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, KEYS, dtype=np.int32)), pa.array(flat.ravel()))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), listed]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "n", "fp", "keys"])

    return texts.select("name", "text").mapInArrow(run, "name binary, n long, fp long, keys array<long>")


def bit_map(found: np.ndarray) -> bytes:
    """A bit for every shingle, placed by its low bits."""
    power = min(max((8 * len(found)).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    bits = np.zeros(1 << power, np.uint8)
    bits[(found & np.uint64((1 << power) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """name, the set and its bit map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py(), words) for t in batch.column(1)]
            held, maps = pa.array([x.tobytes() for x in made], pa.binary()), pa.array([bit_map(x) for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, maps], names=["name", "held", "map"])

    return texts.select("name", "text").mapInArrow(run, "name binary, held binary, map binary")


def _homes(met: DataFrame) -> DataFrame:
    """name and home: texts that met share one, and none holds more than its bytes allow."""
    lowest = met.groupBy("name").agg(F.min("low").alias("label"), F.first("n").alias("n"))
    parts = lowest.groupBy("label").agg(F.ceil(F.sum("n") * 8 / HOME_BYTES).alias("parts"))
    return lowest.join(parts, "label").select("name", F.xxhash64("label", F.pmod(F.xxhash64("name"), F.greatest("parts", F.lit(1)))).alias("home"))


def _confirmed(pairs: DataFrame, sets: DataFrame, homes: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}  # the sets of the tile come before its pairs
        for batch in batches:
            left, right = [], []
            for t, u, v, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if t != tile:
                    tile, held = t, {}
                if v is None:
                    held[u] = np.frombuffer(data.as_py(), np.uint64)
                    continue
                x, y = held[u], held[v]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    left.append(u)
                    right.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["u", "v"])

    at_u, at_v = homes.select(F.col("name").alias("u"), F.col("home").alias("hu")), homes.select(F.col("name").alias("v"), F.col("home").alias("hv"))
    tiled = written(pairs.join(at_u, "u").join(at_v, "v").select(F.xxhash64(F.least("hu", "hv"), F.greatest("hu", "hv")).alias("tile"), "u", "v"), "copies-tiles")
    needed = tiled.select("tile", F.explode(F.array("u", "v")).alias("name")).distinct().join(sets.select("name", "held"), "name")
    none = F.lit(None).cast("binary")
    rows = needed.select("tile", F.col("name").alias("u"), none.alias("v"), "held").unionByName(tiled.withColumn("held", none))
    rows = rows.repartition("tile").sortWithinPartitions("tile", F.col("v").isNotNull())
    return rows.select("tile", "u", "v", "held").mapInArrow(run, "u binary, v binary")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _sized(similarity: float) -> Column:
    """Sets whose sizes alone rule the similarity out are no pair."""
    return F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")


def _with_representative(rooted: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Every member of a key with one member of another component, a different one in each key and turn."""
    first = rooted.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "key", "name").alias("h"), "name", "root", "n")).alias("first"))
    met = rooted.join(first, "key").where(F.col("root") != F.col("first.root")).withColumn("m", F.col("first.n")).where(_sized(similarity))
    return met.select(*_pair(F.col("name"), F.col("first.name"))).distinct()


class _Member:
    """A text of a key: its map in full and folded to half its width, each with the shingles that share a bit with another."""

    def __init__(self, part: int, root: bytes, name: bytes, n: int, bits: bytes) -> None:
        self.part, self.root, self.name, self.n, self.width = part, root, name, n, len(bits) * 8
        whole, half = int.from_bytes(bits, "little"), self.width // 2
        folded = whole & ((1 << half) - 1) | whole >> half
        self.maps = {self.width: (whole, n - whole.bit_count()), half: (folded, n - folded.bit_count())}


def near_enough(a: _Member, b: _Member, similarity: float) -> bool:
    """Whether the maps leave it open that two sets are similar; sizes are within the similarity, so widths differ by one halving at most."""
    width = min(a.width, b.width)
    (x, hidden_x), (y, hidden_y) = a.maps[width], b.maps[width]
    most = (x & y).bit_count() + min(hidden_x, hidden_y)
    return most >= similarity * (a.n + b.n - most)


def _across(rooted: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of one key in different components that may be similar; a component's own pairs are never made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []  # members of the tile so far, by falling size
        out: set[tuple] = set()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in ([u for u, _ in out], [v for _, v in out])], names=["u", "v"])
            out.clear()
            return batch

        for batch in batches:
            for key, low, high, part, root, name, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, low, high) != tile:
                    tile, held = (key, low, high), []
                now = _Member(part, root, name, n, bits)
                for other in reversed(held):
                    if n < similarity * other.n:
                        break
                    if root != other.root and (low == high or part != other.part) and near_enough(now, other, similarity):
                        out.add((max(name, other.name), min(name, other.name)))
                held.append(now)
                if len(out) >= _PAIRS:
                    yield made()
        if out:
            yield made()

    several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("many")).where(F.col("least") != F.col("most"))
    rows = rooted.join(several.select("key", F.ceil(F.col("many") / KEY_ROWS).alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("name"), "parts"))
    # A large key's members are dealt to parts, and every two parts are a tile.
    rows = rows.join(sets.select("name", "map"), "name").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "root", "name", "n", "map")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", F.desc("n"))
    return rows.mapInArrow(run, "u binary, v binary").distinct()


def links(texts: DataFrame, print_of: Callable[[np.ndarray], int], chained: Callable[[DataFrame], DataFrame],
          words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: pairs of similar texts whose components are those of all similar pairs. ``texts`` has name and text.

    ``print_of`` makes a fingerprint of a text's hashes, ``chained`` gives the pairs u, v that the fingerprints of (name, fp) propose.
    """
    # Copies are told apart after the sketch: whole texts are not shuffled for it.
    sketches = written(_sketches(texts, words, print_of).dropDuplicates(["name"]), "copies-keys")
    # Nearly every key has one text, and there are 40 a text: they are shuffled once, with a hash in place of the name. Counting and the join back read
    # that one exchange. Texts whose hashes collide take each other's keys as well, which only adds candidates.
    ids = sketches.select(F.xxhash64("name").alias("h"), "name", "n")
    marked = sketches.select(F.explode("keys").alias("key"), F.xxhash64("name").alias("h")).repartition("key")
    shared = marked.groupBy("key").agg(F.count("*").alias("many"), F.min("h").alias("low")).where(F.col("many") > 1)
    met = written(marked.join(shared.select("key", "low"), "key").join(ids, "h").select("key", "name", "n", "low"), "copies-met")
    homes = written(_homes(met), "copies-homes")
    # Most texts share no key: a bit table of fixed size keeps them from being shuffled only to meet nothing.
    at = F.xxhash64("name").alias("d1")
    perhaps, _ = maybe_in(texts.select("name", "text", at), homes.select(at))
    needed = perhaps.drop("d1").join(homes.select("name"), "name", "left_semi").dropDuplicates(["name"])
    sets = written(_sets(needed, words), "copies-sets")
    found = tried = None
    for turn in range(SPARSE_ROUNDS + 2):
        if turn == 0:
            # Names that share no key have no home: such a pair is less similar than asked for.
            pairs = chained(sketches.select("name", "fp"))
        else:
            roots = written(components(found).select(F.col("node").alias("name"), F.col("root").alias("top")), "copies-roots")
            rooted = met.join(roots, "name", "left").select("key", "name", "n", F.coalesce("top", "name").alias("root"))
            pairs = _with_representative(rooted, turn - 1, similarity) if turn <= SPARSE_ROUNDS else _across(rooted, sets, similarity)
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = written(pairs, "copies-pairs")
        near = written(_confirmed(pairs, sets, homes, similarity), "copies-links")
        found, tried = (near, pairs) if found is None else (found.unionByName(near), tried.unionByName(pairs))
    return found


def name_of(text: Column) -> Column:
    """What a text is known by; equal texts have equal names."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def groups(docs: DataFrame, print_of: Callable[[np.ndarray], int], chained: Callable[[DataFrame], DataFrame],
           words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """name, doc_id, n and root of every different (text, id): how many rows have it, and its group of near copies."""
    named = docs.select("doc_id", name_of(F.col("text")).alias("name"), text_of("text").alias("text"))
    each = written(named.groupBy("name", "doc_id").agg(F.count("*").alias("n")), "copies-classes")
    found = components(links(named.select("name", "text"), print_of, chained, words, similarity)).withColumnRenamed("node", "name")
    return written(each.join(found, "name", "left").select("name", "doc_id", "n", F.coalesce("root", "name").alias("root")), "copies-groups")


def first_of(grouped: DataFrame) -> DataFrame:
    """name, doc_id and n of the first of each group."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name", "n")
    return grouped.groupBy("root").agg(F.min(order).alias("first")).select("first.name", "first.doc_id", "first.n")
