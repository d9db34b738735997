"""Shaping a result for a chart or a table, with a refusal wherever the picture would mislead.

The inputs are results of questions (aggregated rows). Refusals come back as an empty DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.query import normalize_result, precise_sum, top_n
from tallyfold.session import settled, stored

# ---- fixed values: limits and labels ----------------------------------------------------------------
MAX_SERIES = 8
MAX_BARS = 30
MAX_SLICES = 7
MAX_TABLE_ROWS = 500
MAX_LINE_POINTS = 2000
ROWS_PER_PAGE = 25
OTHER_LABEL = "Diğer"
NO_LABEL = "—"
NUMERIC_FORMATS = ["currency", "integer", "number", "percent"]
DATE_FORMATS = ["date", "month"]
ISO_LIKE = r"^\d{4}-\d{2}(-\d{2})?"
# -----------------------------------------------------------------------------------------------------


class TooManySeries(ValueError):
    """More series than can be told apart; limit them first."""


def repeated_cells(df: DataFrame, x: str, series: str | None = None) -> DataFrame:
    """``(x, series)`` pairs that occur more than once: the result is not aggregated to this grain."""
    keys = [x] + ([series] if series else [])
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def series_order(df: DataFrame, series: str, y: str, most: int = MAX_SERIES) -> list:
    """Series labels by importance; at most one more than allowed is looked at."""
    totals = df.groupBy(series).agg(F.coalesce(F.sum(F.abs(F.col(y))), F.lit(0)).alias("total"))
    labels = [r[series] for r in top_n(totals, "total", [series], most + 1).collect()]
    if len(labels) > most:
        raise TooManySeries(f"more than {most} series")
    return labels


def series_pivot(df: DataFrame, x: str, series: str, y: str, most: int = MAX_SERIES) -> DataFrame:
    """One row per x with the series as columns ``s0, s1, …`` (largest first), gaps null, x in order.

    Each column's label is kept as its comment. The columns are known before the job runs, so the
    pivot is a plain aggregate. The points are written once, for the labels and the pivot. More than ``most`` series are refused.
    """
    df = stored(df.select(x, series, y), "series")
    labels = series_order(df, series, y, most)
    cells = [
        F.first(F.when(F.col(series).eqNullSafe(F.lit(label)), F.col(y)), ignorenulls=True).alias(
            f"s{i}", metadata={"comment": NO_LABEL if label is None else str(label)}
        )
        for i, label in enumerate(labels)
    ]
    return df.groupBy(x).agg(*cells).orderBy(x)


def _slices(df: DataFrame, name: str, value: str) -> DataFrame:
    """Named slices, or no row at all when a pie of them would be wrong. The result is written once for all that looks at it."""
    rows = stored(df.select(F.coalesce(F.col(name).cast("string"), F.lit(NO_LABEL)).alias("name"), F.col(value).alias("value")), "slices")
    check = rows.groupBy("name").agg(F.count("*").alias("n"), F.count("value").alias("v"), F.min("value").alias("low"), F.sum("value").alias("s"))
    fair = check.agg(
        ((F.max("n") == 1) & (F.min("v") == 1) & (F.min("low") >= 0) & (F.sum("s") > 0)).alias("fair")
    )
    return rows.filter(fair.scalar())


def fold_other(df: DataFrame, name: str, value: str, other: str = OTHER_LABEL) -> DataFrame:
    """Pie slices ``(name, value, share)``: six largest, the rest folded into one, total preserved."""
    rows = _slices(df, name, value).withColumn("key", F.struct((-F.col("value")).alias("k"), F.col("name")))
    count = rows.agg(F.count("*").alias("n")).scalar()
    last = rows.orderBy("key").limit(MAX_SLICES - 1).agg(F.max("key").alias("key")).scalar()
    kept = (count <= MAX_SLICES) | (F.col("key") <= last)
    folded = rows.groupBy(F.when(kept, F.col("name")).otherwise(F.lit(other)).alias("name")).agg(F.sum("value").alias("value"))
    total = rows.agg(F.sum("value").cast("double").alias("t")).scalar()
    return folded.select("name", F.col("value").cast("double").alias("value"), (F.col("value").cast("double") / total).alias("share"))


def table_totals(df: DataFrame, summable: list[str], complete: bool = True) -> DataFrame:
    """``(column, total)`` for columns that may be summed; nothing for one row or a cut-off result."""
    if not summable or not complete:
        return df.sparkSession.createDataFrame([], "column string, total double")
    row = df.agg(F.count("*").alias("rows"), *[precise_sum(F.col(f"`{c}`").cast("double")).alias(f"t{i}") for i, c in enumerate(summable)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"t{i}").alias("total")) for i, c in enumerate(summable)]
    return row.filter(F.col("rows") > 1).select(F.inline(F.array(*cells)))


def format_check(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """``(column, declared, format)``: a declared format that the values contradict is corrected."""
    plain = normalize_result(df)
    names = plain.columns
    counts = plain.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)])

    def row(i: int, c: str) -> Column:
        is_number = isinstance(plain.schema[c].dataType, T.DoubleType)
        given = declared.get(c)
        filled = F.col(f"n{i}") > 0
        if given is None:
            result = F.when(filled & F.lit(is_number), "number").otherwise("text")
        elif given in NUMERIC_FORMATS and not is_number:
            result = F.when(filled, "text").otherwise(given)
        elif given not in NUMERIC_FORMATS and is_number:
            result = F.when(filled, "number").otherwise(given)
        else:
            result = F.lit(given)
        return F.struct(F.lit(c).alias("column"), F.lit(given).alias("declared"), result.alias("format"))

    return counts.select(F.inline(F.array(*[row(i, c) for i, c in enumerate(names)])))


def valid_views(
    df: DataFrame, summable: list[str] | None = None, partial: bool = False, x: str | None = None, y: str | None = None, series: str | None = None
) -> DataFrame:
    """One row of flags: as what this result may be shown, and the shape it takes by default.

    Without ``x`` a result with one column that is no number is drawn over it. With ``series`` there is a bar or line per label: at most eight
    labels, each pair of x and label once; a pie is offered for a single label only. A series that is x or y itself counts as none.
    """
    plain = normalize_result(df)
    numbers = [f.name for f in plain.schema.fields if isinstance(f.dataType, T.DoubleType)]
    dims = [f.name for f in plain.schema.fields if not isinstance(f.dataType, T.DoubleType)]
    x = x or (dims[0] if len(dims) == 1 else None)
    y = y or (numbers[0] if numbers else None)
    series = None if series in (x, y) else series
    charted = x is not None and y in numbers and x != y
    x_of = F.col(f"`{x}`") if charted else F.lit(None).cast("string")
    y_of = F.col(f"`{y}`") if y in numbers else F.lit(None).cast("double")
    keys = [x_of.alias("x")] + ([F.struct(F.col(f"`{series}`").alias("label")).alias("series")] if series else [])
    cells = plain.groupBy(*keys).agg(F.count("*").alias("n"), F.count(y_of).alias("filled"), F.min(y_of).alias("low"), F.sum(y_of).alias("sum"))
    # Without a series the cells already lie by x, so nothing moves a second time.
    per_x = cells.groupBy("x").agg(
        F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.min("low").alias("low"), F.sum("sum").alias("sum")
    )
    labels = cells.agg(F.count_distinct("series").alias("labels")).scalar() if series else F.lit(1)
    dated = F.coalesce(F.bool_and(F.col("x").isNull() | F.col("x").cast("string").rlike(ISO_LIKE)), F.lit(False)) & F.lit(charted)
    facts = per_x.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("points"),
        (F.max("most") == 1).alias("unique"), (F.sum("filled") == F.sum("n")).alias("filled"),
        F.min("low").alias("low"), F.sum("sum").alias("total"), dated.alias("dated"), labels.alias("labels"),
    )
    whole = F.lit(not partial) & (F.col("rows") > 0)
    drawn = F.lit(charted) & F.coalesce(F.col("unique"), F.lit(False)) & (F.col("labels") <= MAX_SERIES)
    default = (
        F.when(F.col("rows") == 0, "empty").when(F.lit(partial), "table").when(F.col("rows") == 1, "metric")
        .when(F.col("bar") & ~F.col("dated"), "bar").when(F.col("line"), "line").otherwise("table")
    )
    can_sum = charted and y in (summable or [])
    return (
        facts.withColumn("bar", whole & drawn & (F.col("points") <= MAX_BARS))
        .withColumn("line", whole & drawn & F.col("dated") & (F.col("points") <= MAX_LINE_POINTS))
        .withColumn("pie", whole & drawn & (F.col("labels") == 1) & F.lit(can_sum) & F.col("filled") & (F.col("low") >= 0) & (F.col("total") > 0))
        .withColumn("metric", whole & (F.col("rows") == 1))
        .withColumn("table", F.col("rows") > 0)
        .withColumn("default_view", default)
        .select("rows", "metric", "bar", "line", "pie", "table", "default_view")
    )


def number_rows(df: DataFrame, *order) -> DataFrame:
    """``row_no`` from 1 in the given order, counted by all tasks at once.

    The sorted pieces are settled first, then every piece is numbered on its own and shifted by the
    sizes of the pieces before it; only one row per piece is gathered for that.
    """
    piece, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = settled(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    sizes = ordered.groupBy(piece.alias("piece")).agg((F.max(place) + 1).alias("size"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return ordered.withColumn("piece", piece).join(starts, "piece").withColumn("row_no", F.col("start") + place + 1).drop("piece", "start", "at")


def page_rows(df: DataFrame, order: list, per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """Rows with their page number; the last page may be short."""
    return number_rows(df, *order).withColumn("page", F.floor((F.col("row_no") - 1) / per_page).cast("bigint"))
