"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sources in code point order (null last) get weights; each source's target is its share of the wanted total,
   but at most ``passes`` times what it has, and what is cut off is shared again by weight until nothing is above.
2. Each source's documents are shuffled by a hash and laid out as one stream of words, read ``passes`` times over and
   cut into blocks of equal size.
3. Slot k of the schedule stands at frac(k · golden ratio) on the cumulative targets, which names its source; the r-th slot
   of a source takes the r-th block of its stream. The golden ratio spreads the slots of every source evenly, so any
   stretch of the mix has the sources near their weights. A source with fewer slots than its target has blocks gets the missing ones
   at frac(k · golden ratio) of the mix.
4. Joining slots with blocks gives the words that each document lends. The last block is cut at the target.

Nothing is gathered per source: streams and slot ranks are summed in two levels (piece sums, then the
rows of one piece), and slots meet blocks by (source, block).

Defined cases: a null text has no words; documents without words lend none and have taken = 0; a null source is a source;
repeated rows are documents of their own; a null ``doc_id`` is carried; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import WORD, written

GOLDEN = (math.sqrt(5) - 1) / 2
WEIGHTS = (3, 1, 2)
PIECES = 4096  # pieces of a source's shuffled stream
SLOTS_IN_PIECE = 1 << 14
BLOCK_WORDS = 256


def _before(*keys, order):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def source_targets(sizes: DataFrame, share: float = 1.5, passes: int = 2, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    A source whose cap per weight is at most the common level stays at its cap. The level is found in one
    ordering by cap per weight: the first n sources are capped where the level of the rest reaches the n-th.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    picked = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("double")
    facts = ranked.withColumn("weight", picked).withColumn("cap", F.col("source_size").cast("double") * passes).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = facts.withColumn("goal", F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).withColumn("all_weights", F.sum("weight").over(Window.partitionBy()))
    left = F.greatest(F.col("goal") - F.coalesce(F.sum("cap").over(up), F.lit(0.0)), F.lit(0.0))
    level = left / (F.col("all_weights") - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    # Above the capped sources the level is the same for all of them: that of the first one that stays below its cap.
    leveled = everything.withColumn("level", level).withColumn("fits", F.col("ratio") > F.col("level"))
    common = F.min(F.when(F.col("fits"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())
    return leveled.withColumn("common", common["level"]).select(
        "source", "source_size", F.when(F.col("common").isNull() | (F.col("cap") <= F.col("weight") * F.col("common")), F.col("cap")).otherwise(F.col("weight") * F.col("common")).alias("target"), "rank")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source_no, block: the slots of the mix in order.

    The cumulative targets are cut at the borders of equal cells, a few per source, so a slot finds its source by its cell.
    """
    spark = targets.sparkSession
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    laid = targets.where(F.col("target") > 0).withColumn("high", F.sum("target").over(upto) / F.sum("target").over(whole)).withColumn(
        "low", F.coalesce(F.lag("high").over(Window.orderBy("source_no")), F.lit(0.0)))
    counts = laid.agg(F.sum("target").alias("words"), F.count("*").alias("sources")).first()
    words, sources = counts["words"] or 0.0, counts["sources"]
    slots = math.ceil(words / block_words * 1.01) + 8 * sources if sources else 0
    cells = 4 * max(sources, 1)
    last = F.when(F.col("high") >= 1 - 1e-12, cells - 1).otherwise(F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))
    ranges = laid.select("source_no", "low", F.when(F.col("high") >= 1 - 1e-12, F.lit(1.0)).otherwise(F.col("high")).alias("high"), F.explode(F.sequence(F.floor(F.col("low") * cells), last.cast("bigint"))).alias("cell"))
    place = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", place - F.floor(place)).withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    found = points.join(ranges, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("slot", "source_no")
    # The points give a source its share only within a few slots, which may be all that a small source has.
    given = found.groupBy("source_no").agg(F.count("*").alias("given"))
    lacking = laid.select("source_no", F.ceil(F.col("target") / block_words).alias("blocks")).join(given, "source_no", "left").withColumn(
        "lacking", F.col("blocks") - F.coalesce("given", F.lit(0))).where(F.col("lacking") > 0)
    turn = F.col("turn") * F.lit(GOLDEN)
    more = lacking.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("lacking")))).select(F.floor((turn - F.floor(turn)) * slots).alias("slot"), "source_no")
    found = found.unionByName(more).withColumn("piece", F.floor(F.col("slot") / SLOTS_IN_PIECE))
    sizes = found.groupBy("source_no", "piece").agg(F.count("*").alias("n"))
    starts = sizes.select("source_no", "piece", F.coalesce(F.sum("n").over(_before("source_no", order="piece")), F.lit(0)).alias("start"))
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("source_no", "piece").orderBy("slot")) - 1)
    return ranked.join(starts, ["source_no", "piece"]).select("slot", "source_no", (F.col("start") + F.col("place")).alias("block"))


def mix(docs: DataFrame, share: float = 1.5, passes: int = 2, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix_with_source(docs, share, passes, weights, block_words, seed).drop("source")


def mix_with_source(docs: DataFrame, share: float = 1.5, passes: int = 2, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    return _mixed(docs.select("doc_id", "source", _size(F.col("text")).alias("size")), share, passes, weights, block_words, seed)


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _mixed(sized: DataFrame, share, passes, weights, block_words, seed) -> DataFrame:
    shuffled = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = written(sized.withColumn("at", shuffled).withColumn("piece", F.pmod(F.shiftrightunsigned("at", 20), F.lit(PIECES))), "mix-sizes")
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sums, share, passes, weights).withColumnRenamed("rank", "source_no"), "mix-targets")
    pieces = docs.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    starts = pieces.join(targets, pieces["source"].eqNullSafe(targets["source"])).select(
        pieces["source"].alias("of"), F.col("piece").alias("in_piece"), "source_no", "source_size", "target", F.coalesce(F.sum("words").over(_before("source_no", order="piece")), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "piece").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("row", F.monotonically_increasing_id())
    laid = written(placed.join(starts, docs["source"].eqNullSafe(starts["of"]) & (F.col("piece") == F.col("in_piece"))).select(
        "row", "doc_id", "source", "size", "source_no", "source_size", "target", (F.col("start") + F.col("within")).alias("offset")), "mix-streams")

    # A document's words in pass p are [offset + p * source_size, … + size); it lies in one or more blocks.
    turns = laid.where(F.col("size") > 0).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select(
        "row", "source_no", "target", (F.col("offset") + F.col("source_size") * F.col("turn")).alias("lo"), "size")
    bounded = turns.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.floor("target"))).where(F.col("hi") > F.col("lo"))
    parts = bounded.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words)))).select(
        "row", "source_no", "block", (F.least(F.col("hi"), (F.col("block") + 1) * block_words) - F.greatest(F.col("lo"), F.col("block") * block_words)).alias("words"))
    taken = parts.join(schedule(targets, block_words), ["source_no", "block"]).groupBy("row").agg(F.sum("words").alias("taken"))
    return laid.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents as often as the mix takes them: not at all, or once per pass that takes any of their words.

    Documents without words cost nothing and stay once. Rows that share id and source are taken equally often. All columns stay.
    """
    took = mix_with_source(docs, **settings)
    times = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    per_key = written(took.groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source")).agg(F.max(times).alias("mix_times")).where(F.col("mix_times") > 0), "mix-times")
    # Each row travels as one struct, so its columns cannot clash with those of the mix.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("kept"))
    # One plan at every size: beyond the smallest tables the keys are too many to be sent whole to every executor, and texts need not be sorted to meet them.
    kept = rows.join(per_key.hint("shuffle_hash"), F.col("kept.doc_id").eqNullSafe(F.col("mix_id")) & F.col("kept.source").eqNullSafe(F.col("mix_source")))
    return kept.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("kept.*")
