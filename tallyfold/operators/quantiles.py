"""Exact order statistics and quantiles, of a whole column or of every group, without gathering a group anywhere."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.session import stored

# A task orders at most about so many values of one range.
KEPT_VALUES = 100_000
# Into how many parts a range is cut at a time.
PARTS = 64
_ACCURACY = 10_000


def approximate_quantiles(df: DataFrame, value: str, probabilities: list[float]) -> DataFrame:
    """One row of approximate quantiles ``q0…``; a bounded sketch per task."""
    return df.agg(*[
        F.percentile_approx(F.col(value), F.lit(p), F.lit(_ACCURACY)).alias(f"q{i}")
        for i, p in enumerate(probabilities)
    ])


def _inside(x: Column) -> Column:
    """Strictly between the bounds of a range; a null bound is open."""
    return (F.col("lo").isNull() | (x > F.col("lo"))) & (F.col("hi").isNull() | (x < F.col("hi")))


_RANGE = ["g", "lo", "hi"]


def _same_range(a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in _RANGE))


def _narrowed(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (g, rank, below, inside, lo, hi, value) after every range was cut once more.

    A sketch of each range only proposes where to cut. The exact counts of the parts, and of the values that equal a cut, then tell in
    which part a rank lies; a rank at a cut has its value.
    """
    ranges = stored(wanted.select(*_RANGE).distinct(), "rank-ranges")
    shares = [i / PARTS for i in range(PARTS + 1)]
    held = rows.join(ranges, "g").where(_inside(F.col("x")))
    sketch = F.array_sort(F.array_distinct(F.percentile_approx("x", F.array(*map(F.lit, shares)), F.lit(_ACCURACY))))
    cuts = stored(held.groupBy(*_RANGE).agg(sketch.alias("cuts")), "rank-cuts")
    # Part 2j lies below cut j (counted from 0) and above the one before, part 2j + 1 is the cut itself.
    x = F.col("x")
    part = F.size(F.filter("cuts", lambda c: c < x)) + F.size(F.filter("cuts", lambda c: c <= x))
    counted = rows.join(cuts, "g").where(_inside(x)).groupBy(*_RANGE, part.alias("part")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*_RANGE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    parts = stored(parts.join(cuts, _same_range(parts, cuts)).select(*[parts[c] for c in _RANGE], "part", "n", "ahead", "cuts"), "rank-parts")
    found = wanted.join(parts, _same_range(wanted, parts) & (wanted["rank"] - wanted["below"]).between(parts["ahead"], parts["ahead"] + parts["n"] - 1))
    cut = F.floor(F.col("part") / 2).cast("int")
    at_cut = F.col("part") % 2 == 1
    return found.select(
        wanted["g"], "rank", (F.col("below") + F.col("ahead")).alias("below"), F.col("n").alias("inside"),
        F.when(cut > 0, F.try_element_at("cuts", cut)).otherwise(wanted["lo"]).alias("lo"), F.coalesce(F.try_element_at("cuts", cut + 1), wanted["hi"]).alias("hi"),
        F.when(at_cut, F.try_element_at("cuts", cut + 1)).alias("value"))


def _at_ranks(rows: DataFrame, wanted: DataFrame, keep: int) -> DataFrame:
    """g, rank, value: the value of every wanted rank. ``rows`` has g and x; ``wanted`` has g, rank (from 0) and ``inside``, the size of g."""
    kind = dict(rows.dtypes)["x"]
    none = F.lit(None).cast(kind)
    active = stored(wanted.select("g", "rank", F.lit(0).cast("bigint").alias("below"), "inside", none.alias("lo"), none.alias("hi"), none.alias("value")), "rank-wanted")
    open_ = F.col("value").isNull()
    ready = [active.where(F.col("inside") <= keep)]
    active = active.where(F.col("inside") > keep)
    # Groups of at most ``keep`` values are never cut; the others shrink by the number of parts each time.
    while not active.isEmpty():
        cut = stored(_narrowed(rows, active), "rank-narrowed")
        ready.append(cut.where(~open_ | (F.col("inside") <= keep)))
        active = cut.where(open_ & (F.col("inside") > keep))
    settled = reduce(DataFrame.unionByName, ready)
    left = settled.where(open_)
    ranges = left.select(*_RANGE).distinct()
    tally = rows.join(ranges, "g").where(_inside(F.col("x"))).groupBy(*_RANGE, "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_RANGE).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    running = tally.withColumn("upto", upto).select(*[F.col(c).alias(f"of_{c}") for c in _RANGE], "x", "n", "upto")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in _RANGE))
    place = F.col("rank") - F.col("below")
    met = left.join(running, same & (place < F.col("upto")) & (place >= F.col("upto") - F.col("n")))
    return settled.where(~open_).select("g", "rank", "value").unionByName(met.select("g", "rank", F.col("x").alias("value")))


def _grouped(df: DataFrame, keys: list[str], x: Column) -> tuple[DataFrame, DataFrame]:
    """The rows (g, x) written once, and the size of each group. All keys travel as one struct, in which nulls are equal."""
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = stored(df.select(group.alias("g"), x.alias("x")).where(F.col("x").isNotNull()), "rank-rows")
    return rows, stored(rows.groupBy("g").agg(F.count("*").alias("inside")), "rank-sizes")


def value_at_rank(df: DataFrame, keys: list[str], value: str, ranks: DataFrame, keep: int = KEPT_VALUES) -> DataFrame:
    """The keys and ``value``: in every group the value whose rank, counted from 0, is the group's ``rank`` in ``ranks``; ranks beyond a group give no row."""
    rows, sizes = _grouped(df, keys, F.col(value))
    wanted = ranks.select(F.struct(*[F.col(k) for k in keys]).alias("g"), F.col("rank").cast("bigint").alias("rank"))
    wanted = wanted.join(sizes, "g").where(F.col("rank").between(F.lit(0), F.col("inside") - 1))
    return _at_ranks(rows, wanted, keep).select("g.*", F.col("value").alias(value))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], keep: int = KEPT_VALUES) -> DataFrame:
    """The keys and ``q0, q1, …``: interpolated quantiles (continuous, on doubles) of every group that has values.

    All ranges of all groups are narrowed together, by counts per (group, part of a range): a group that has most of the rows is counted where its rows are,
    and only ranges of at most ``keep`` values are ordered.
    """
    rows, sizes = _grouped(df, keys, F.col(value).cast("double"))
    position = [F.lit(p) * (F.col("inside") - 1) for p in probabilities]
    every = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in position])))
    wanted = sizes.select("g", "inside", F.explode(every).alias("rank"))
    values = _at_ranks(rows, wanted, keep).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    both = sizes.join(values, "g")

    def quantile(p: Column) -> Column:
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return F.when(low == high, low).otherwise(low + (high - low) * (p - F.floor(p)))

    return both.select("g.*", *[quantile(p).alias(f"q{i}") for i, p in enumerate(position)])


class _Range:
    """A value range that holds the 0-based ranks ``low`` and ``high``; None stands for the column's ends."""

    def __init__(self, position: float):
        self.low, self.high = math.floor(position), math.ceil(position)
        self.share = position - self.low
        self.bounds: tuple[float, float] | None = None
        self.below, self.inside, self.margin, self.done = 0, 0, 4.0 / _ACCURACY, False

    def within(self, x: Column) -> Column:
        return x.between(F.lit(self.bounds[0]), F.lit(self.bounds[1])) if self.bounds else F.lit(True)

    def proposal(self, x: Column, name: str) -> Column:
        """A sketch of the values in the range, asked a little below and above the wanted ranks."""
        first, last = (self.low - self.below) / self.inside, (self.high - self.below) / self.inside
        shares = F.array(F.lit(max(0.0, first - self.margin)), F.lit(min(1.0, last + self.margin)))
        return F.percentile_approx(F.when(self.within(x), x), shares, F.lit(_ACCURACY)).alias(name)


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], keep: int = KEPT_VALUES) -> DataFrame:
    """One row ``q0, q1, …`` of interpolated quantiles (continuous, on doubles).

    All quantiles are narrowed together: sketches propose a range for each, one pass of exact counts confirms
    that the ranges hold the wanted ranks, and one more pass counts the distinct values in the ranges, which are then
    ordered. A range that still holds more than ``keep`` values is narrowed again.
    """
    x = F.col("x")
    source = df.select(F.col(value).cast("double").alias("x")).filter(x.isNotNull())
    names = [f"q{i}" for i in range(len(probabilities))]
    schema = ", ".join(f"{n} double" for n in names)
    count = source.count()
    if not count:
        return df.sparkSession.createDataFrame([(None,) * len(names)], schema)
    ranges = [_Range(p * (count - 1)) for p in probabilities]
    for r in ranges:
        r.inside = count
    while active := [r for r in ranges if not r.done]:
        bounds = source.agg(*[r.proposal(x, f"b{i}") for i, r in enumerate(active)]).first()
        tries = [tuple(bounds[f"b{i}"]) for i in range(len(active))]
        counts = source.agg(*[c for i, (lo, hi) in enumerate(tries) for c in (
            F.count_if(x < F.lit(lo)).alias(f"l{i}"), F.count_if(x.between(F.lit(lo), F.lit(hi))).alias(f"w{i}"))]).first()
        for i, (r, found) in enumerate(zip(active, tries)):
            below, inside = counts[f"l{i}"], counts[f"w{i}"]
            if not (below <= r.low and r.high < below + inside):
                r.margin *= 4  # the sketch missed: look wider, never guess
                continue
            # A range that does not shrink is held by values equal to its ends; counting distinct values copes with those.
            r.done = inside <= keep or found[0] == found[1] or inside == r.inside
            r.bounds, r.below, r.inside = found, below, inside
    asked = F.array(*[
        F.when(r.within(x), F.struct(F.lit(i).alias("i"), F.lit(r.below).cast("bigint").alias("below"), F.lit(r.low).cast("bigint").alias("low"), F.lit(r.high).cast("bigint").alias("high")))
        for i, r in enumerate(ranges)])
    tally = source.select("x", F.explode(F.filter(asked, lambda a: a.isNotNull())).alias("a")).groupBy("a", "x").count()
    running = F.sum("count").over(Window.partitionBy("a").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("a.below")
    reached = tally.withColumn("upto", running)
    ends = reached.groupBy("a.i").agg(F.min(F.when(F.col("upto") > F.col("a.low"), x)).alias("lo"), F.min(F.when(F.col("upto") > F.col("a.high"), x)).alias("hi")).collect()
    found = {row["i"]: row["lo"] + (row["hi"] - row["lo"]) * ranges[row["i"]].share if row["hi"] != row["lo"] else row["lo"] for row in ends}
    return df.sparkSession.createDataFrame([tuple(found[i] for i in range(len(names)))], schema)


def quantile_value(df: DataFrame, value: str, probability: float) -> Column:
    """One exact quantile as a scalar to compare rows with."""
    return exact_quantiles(df, value, [probability]).scalar()
