"""The numbers behind a one-sentence takeaway, computed from the result itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import quantiles as Z
from tallyfold.operators import shape as S
from tallyfold.session import stored

# ---- fixed values -----------------------------------------------------------------------------------
INCOMPLETE_SHARE = 0.25
MIN_POINTS_INCOMPLETE = 4
MIN_POINTS_PARTIAL = 3
# -----------------------------------------------------------------------------------------------------


def bar_facts(df: DataFrame, x: str, y: str, summable: bool = False, series: str | None = None) -> DataFrame:
    """Largest and smallest bar, how far apart, and the sum where summing means something.

    With ``series`` every pair of x and label is a bar; ``max_series`` and ``min_series`` name the labels. Equal bars: the smaller x, then label.
    """
    label = [F.coalesce(F.col(series).cast("string"), F.lit(S.NO_LABEL)).alias("series")] if series else []
    points = df.filter(F.col(y).isNotNull()).select(F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y"), *label)
    bar = ["x", "series"] if series else ["x"]
    row = points.agg(
        F.count("*").alias("points"),
        F.min_by(F.struct(*bar), F.struct(-F.col("y"), *bar)).alias("max"), F.max("y").alias("max_value"),
        F.min_by(F.struct(*bar), F.struct("y", *bar)).alias("min"), F.min("y").alias("min_value"),
        (F.sum("y") if summable else F.max(F.lit(None).cast("double"))).alias("total"),
    )
    names = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in bar for side in ("max", "min")]
    row = row.select("points", *names, "max_value", "min_value", "total")
    apart = F.when(F.col("min_value") > 0, (F.col("max_value") - F.col("min_value")) / F.col("min_value"))
    return row.filter(F.col("points") > 0).withColumn("all_equal", F.col("max_value") == F.col("min_value")).withColumn(
        "difference", F.when(~F.col("all_equal"), apart)
    )


def _change(start: Column, end: Column) -> Column:
    return F.try_divide(end - start, F.abs(start))


def line_facts(
    df: DataFrame, x: str, y: str, cumulative: bool = False, coverage: tuple[str, str] | None = None, monthly: bool = True
) -> DataFrame:
    """First, end and peak of a line and the change between first and end.

    With the data's date range, edge months covered only partly are left out of the comparison;
    without it a last period far below the others counts as unfinished. A running total only reports
    what it reached. The edges come from two rank limits and the rest from one aggregate and one exact
    median, so a line may have any number of points.
    """
    rows = stored(df.filter(F.col(y).isNotNull()).select(F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y")), "line")
    point = F.struct("x", "y")
    one = rows.agg(F.count("*").alias("n"), F.min(point).alias("first"), F.max(point).alias("last"), F.min(F.struct((-F.col("y")).alias("down"), F.col("x"))).alias("peak")).filter(F.col("n") > 0)
    # With a single point the neighbour of an edge is missing.
    second = rows.orderBy("x", "y").limit(2).agg(F.max(point).alias("p")).scalar()
    before_last = rows.orderBy(F.desc("x"), F.desc("y")).limit(2).agg(F.min(point).alias("p")).scalar()
    n, first, last = F.col("n"), F.col("first"), F.col("last")

    def edge(point: Column, day: str, is_start: bool) -> Column:
        whole = F.to_date(F.lit(day[:10]))
        same = F.left(point["x"], F.lit(7)) == F.lit(day[:7])
        return same & (F.dayofmonth(whole) > 1 if is_start else whole < F.last_day(whole))

    no = F.lit(False)
    start_partial = edge(first, coverage[0], True) & (n >= MIN_POINTS_PARTIAL) if coverage and monthly else no
    end_partial = edge(last, coverage[1], False) & (n >= MIN_POINTS_PARTIAL) if coverage and monthly else no
    facts = one.withColumn("second", second).withColumn("before_last", before_last).withColumn("start_partial", start_partial).withColumn("end_partial", end_partial)
    if cumulative:
        facts = facts.withColumn("incomplete_last", no)
    else:
        last_x = rows.agg(F.max("x").alias("x")).scalar()
        middle = Z.quantile_value(rows.filter(F.col("x") < last_x), "y", 0.5)
        low = (n >= MIN_POINTS_INCOMPLETE) & (last["y"] >= 0) & (last["y"] < INCOMPLETE_SHARE * middle)
        facts = facts.withColumn("incomplete_last", ~(F.col("start_partial") | F.col("end_partial")) & F.coalesce(low, no))
    start = F.when(F.col("start_partial"), F.col("second")).otherwise(first)
    step_back = (F.col("end_partial") | F.col("incomplete_last")) & F.lit(not cumulative)
    end = F.when(step_back, F.col("before_last")).otherwise(last)
    change = F.lit(None).cast("double") if cumulative else F.when(n > 1, _change(F.col("start.y"), F.col("end.y")))
    return facts.withColumn("start", start).withColumn("end", end).select(
        n.cast("int").alias("points"), F.col("start.x").alias("from_x"), F.col("start.y").alias("from_value"),
        F.col("end.x").alias("to_x"), F.col("end.y").alias("to_value"), change.alias("change"),
        F.col("peak.x").alias("peak_x"), (-F.col("peak.down")).alias("peak_value"),
        "start_partial", "end_partial", "incomplete_last",
    )


def series_leader(df: DataFrame, x: str, series: str, y: str) -> DataFrame:
    """The leading series at the last x."""
    last = df.agg(F.max(x).alias("x")).scalar()
    points = df.filter((F.col(x) == last) & F.col(y).isNotNull())
    return points.agg(F.max(x).alias("x"), F.min_by(series, F.struct(-F.col(y), F.col(series))).alias("leader"), F.max(y).alias("value")).filter(
        F.col("leader").isNotNull()
    )


def pie_facts(df: DataFrame, name: str, value: str, other: str = S.OTHER_LABEL) -> DataFrame:
    """Largest slice with its share, and the total."""
    df = stored(df.select(name, value), "pie")
    slices = S.fold_other(df, name, value, other)
    raw = df.select(F.coalesce(F.col(name).cast("string"), F.lit(S.NO_LABEL)).alias("name"), F.col(value).cast("double").alias("v"))
    lead = raw.agg(F.min_by("name", F.struct(-F.col("v"), F.col("name"))).alias("name")).scalar()
    total = slices.agg(F.sum("value").alias("total")).scalar()
    return slices.filter(F.col("name") == lead).select("name", "value", "share", total.alias("total"))


def table_facts(df: DataFrame, summable: list[str], partial: bool = False) -> DataFrame:
    """Row count, whether only a part is shown, and the totals as a map."""
    totals = S.table_totals(df, summable, not partial).agg(F.map_from_entries(F.collect_list(F.struct("column", "total"))).alias("totals"))
    rows = df.agg(F.count("*").alias("rows"))
    return rows.select(
        "rows", (F.lit(partial) | (F.col("rows") > S.MAX_TABLE_ROWS)).alias("truncated"), F.lit(partial).alias("partial"), totals.scalar().alias("totals")
    )
