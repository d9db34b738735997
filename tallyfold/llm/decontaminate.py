"""Benchmark decontamination with a positional inverted index, on DataFrame functions only.

1. Benchmark texts are cut into windows of consecutive words; how often each of their words occurs in the training texts is counted.
2. The index stores the postings of the words that are some window's rarest word: document, position and the words around it.
   No other posting can begin a match, so common words are not stored unless a window has nothing rarer.
3. A posting is shifted by the offset its word has in a window: that is where the window would start. The words at the
   other offsets are compared with the window's words by meeting on the shifted passage, so postings are never paired with each other or with all
   windows of a word; a posting has at most one row per offset and length.
4. Matches are merged per document into hit words and items.

The benchmark side is broadcast only while it is small (checked by its size); beyond that it is joined by sorting.

Texts are taken as bytes read one character each, where only A-Z have a lower-case form that matters: equal bytes stay
equal and different ones different, and the word pattern sees every byte of a non-ASCII letter as a word character.

Defined cases: a null text has no words; texts or items without words match nothing; an item shorter than a window is one
window; repeated items count once by their id, items without an id hit but are not listed; repeated documents are reported as often as
they occur; empty tables give no rows or no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of, written
from tallyfold.llm.near_copies import name_of

WINDOW_WORDS = 10
# The word pattern of the contract: fixed value.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = "\0"  # no word; its posting stands behind a document's last word
SMALL_BYTES, SMALL_ROWS = 32 << 20, 500_000


def words_of(text: Column) -> Column:
    plain = F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _small(table: DataFrame, text: str) -> DataFrame:
    """The table, marked for broadcast if its rows and texts are within the bounds."""
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(table) if size["n"] <= SMALL_ROWS and size["bytes"] <= SMALL_BYTES else table


def benchmark_windows(items: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """item_id, gram (the window's words joined by spaces), words: every distinct window of every item."""
    split = items.select("item_id", words_of(text_of("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    cut = split.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), width).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("gram"), "words").dropDuplicates(["item_id", "gram"])


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, count: occurrences in the training texts of the given terms."""
    spoken = docs.select(F.explode(words_of(text_of("text"))).alias("term"))
    return spoken.join(_small(terms, "term"), "term").groupBy("term").agg(F.count("*").alias("count"))


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, words, term, offset, length: each window with its rarest word. Windows with a word that never occurs are left out."""
    grams = windows.select("gram", "words").dropDuplicates(["gram"])
    placed = grams.select("gram", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    rarest = placed.groupBy("gram").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term", "offset")).alias("r")).where(F.col("r.count") > 0)
    return grams.join(rarest, "gram").select("gram", "words", "r.term", "r.offset", F.size("words").alias("length"))


def postings(docs: DataFrame, terms: DataFrame, radius: int) -> DataFrame:
    """The positional index: row, doc_id, term, pos, at, around, for the given terms.

    ``around`` holds the words up to ``radius`` before and behind, ``at`` the term's place in it. Each document also has one row with the end mark as its term,
    whose position is its number of words.
    """
    listed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(words_of(text_of("text")), F.array(F.lit(_END))).alias("w"))
    wanted = terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit(_END).alias("term")))
    found = listed.select("doc_id", "row", "w", F.posexplode("w").alias("pos", "term")).join(_small(wanted, "term"), "term")
    low = F.greatest(F.col("pos") - radius, F.lit(0))
    around = F.when(F.col("term") != _END, F.slice("w", low + 1, F.col("pos") - low + 1 + radius))
    return found.select("row", "doc_id", "term", "pos", (F.col("pos") - low).alias("at"), around.alias("around"))


def phrase_matches(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """row, start, length, gram: where whole windows stand in the documents."""
    shapes = anchored.groupBy("term").agg(F.collect_set(F.struct("offset", "length")).alias("shapes"))
    shifted = index.where(F.col("term") != _END).join(_small(shapes, "term"), "term").select("row", "pos", "at", "around", F.explode("shapes").alias("s"))
    inside = shifted.where(F.col("at") >= F.col("s.offset"))
    passage = F.slice("around", F.col("at") - F.col("s.offset") + 1, F.col("s.length"))
    starts = inside.select("row", (F.col("pos") - F.col("s.offset")).alias("start"), F.col("s.length").alias("length"), F.array_join(passage, " ").alias("gram"))
    return starts.join(_small(anchored.select("gram"), "gram"), "gram").select("row", "start", "length", "gram").distinct()


def proximity_matches(index: DataFrame, anchored: DataFrame, slop: int) -> DataFrame:
    """row, pos, gram: all words of a window stand, in any order, within ``slop`` + its length - 1 words of its rarest word.

    The index needs a radius of at least the width - 1 + ``slop``. Postings meet windows by the rarest word together with a second word of the window nearby.
    """
    second = F.array_max(F.filter("words", lambda w: w != F.col("term")))
    pairs = anchored.withColumn("second", F.coalesce(second, F.col("term"))).withColumnRenamed("length", "window_length")
    low = F.greatest(F.col("at") - (F.col("window_length") - 1 + slop), F.lit(0))
    near = index.where(F.col("term") != _END).withColumn("second", F.explode(F.array_distinct("around")))
    met = near.join(pairs, ["term", "second"]).withColumn("around", F.slice("around", low + 1, F.col("at") - low + F.col("window_length") + slop))
    return met.where(F.size(F.array_except("words", "around")) == 0).select("row", "pos", "gram").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    windows = written(benchmark_windows(items, width), "bench-windows")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    counts = written(term_counts(docs, written(terms, "bench-terms")), "bench-term-counts")
    anchored = written(anchors(windows, counts), "bench-anchors")
    index = written(postings(docs, anchored.select("term").distinct(), width - 1), "postings")
    hits = written(phrase_matches(index, anchored), "bench-hits")

    ordered = Window.partitionBy("row").orderBy("start", "length")
    reached = F.max(F.col("start") + F.col("length")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("start") + F.col("length") - F.greatest("start", F.coalesce(reached, F.lit(0))), F.lit(0))
    covered = hits.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = windows.select("gram", F.col("item_id").cast("string").alias("item")).where(F.col("item").isNotNull())
    listed = hits.select("row", "gram").distinct().join(named, "gram").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    every = index.where(F.col("term") == _END).select("row", "doc_id", F.col("pos").cast("bigint").alias("n_words"))
    joined = every.join(covered, "row", "left").join(listed, "row", "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("bigint").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """The documents without a hit; all columns stay. Rows are judged by their texts: an id may be shared or missing."""
    named = docs.select(name_of(F.col("text")).alias("doc_id"), "text")
    dropped = written(decontaminate(named, items, width).where("contaminated").select(F.col("doc_id").alias("name")).distinct(), "contaminated")
    return docs.join(dropped, name_of(docs["text"]) == dropped["name"], "left_anti")
