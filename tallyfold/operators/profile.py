"""Column profile: filled cells, distinct values, range and most frequent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values ------------------------------------------------------------------------------
TOP_VALUES = 3
# ------------------------------------------------------------------------------------------------


def coarse_type(t: T.DataType) -> str:
    """``number``, ``date`` or ``text``."""
    if isinstance(t, T.NumericType):
        return "number"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def columns_of(df: DataFrame, kind: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if kind is None or coarse_type(f.dataType) == kind]


def _wide_to_long(df: DataFrame, columns: list[str], facts: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate row with every column's facts, laid out as one row per column."""
    aggs = [agg.alias(f"{fact}_{i}") for fact, by_column in facts.items() for i, c in enumerate(columns) for agg in [by_column[c]]]
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{fact}_{i}").alias(fact) for fact in facts])
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def filled(df: DataFrame) -> DataFrame:
    cols = columns_of(df)
    return _wide_to_long(df, cols, {"filled": {c: F.count(f"`{c}`") for c in cols}})


def distinct(df: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct values per column, by a sketch or exactly."""
    cols = columns_of(df)
    if not exact:
        return _wide_to_long(df, cols, {"distinct": {c: F.approx_count_distinct(f"`{c}`") for c in cols}})
    # Exact: one narrow pass that first collapses equal cells where they are.
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols
    ])))
    return cells.groupBy("column", "value").count().groupBy("column").agg(F.count("value").alias("distinct"))


def value_range(df: DataFrame) -> DataFrame:
    """Smallest and largest number, or first and last date as text; text columns have no range."""
    cols = columns_of(df)
    kinds = {f.name: coarse_type(f.dataType) for f in df.schema.fields}

    def bound(pick, kind: str, c: str) -> Column:
        if kinds[c] != kind:
            return F.max(F.lit(None).cast("double" if kind == "number" else "string"))
        return pick(f"`{c}`").cast("double") if kind == "number" else F.date_format(pick(f"`{c}`"), "yyyy-MM-dd HH:mm")

    facts = {
        f"{name}_{kind}": {c: bound(pick, kind, c) for c in cols}
        for name, pick in (("min", F.min), ("max", F.max)) for kind in ("number", "date")
    }
    return _wide_to_long(df, cols, facts)


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = TOP_VALUES) -> DataFrame:
    """``(column, rank, value, count)``: the most frequent values of every text column, in one job.

    Counting collapses equal values before the shuffle, and the rank limit is applied per task before
    the columns are brought together, so neither a hot value nor a wide column gathers in one task.
    """
    columns = columns or columns_of(df, "text")
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ])))
    counts = cells.filter(F.col("value").isNotNull()).groupBy("column", "value").count()
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("column", "rank", "value", "count")


def coverage(df: DataFrame) -> DataFrame:
    """First and last moment when the table has exactly one date column; otherwise no row."""
    dates = columns_of(df, "date")
    if len(dates) != 1:
        return df.sparkSession.createDataFrame([], "from string, to string")
    shape = "yyyy-MM-dd HH:mm"
    row = df.agg(F.date_format(F.min(f"`{dates[0]}`"), shape).alias("from"), F.date_format(F.max(f"`{dates[0]}`"), shape).alias("to"))
    return row.filter(F.col("from").isNotNull())


def profile_table(df: DataFrame) -> DataFrame:
    """``(column, type, filled, distinct, min, max, top)`` — one aggregate pass and one counting pass."""
    cols = columns_of(df)
    kinds = {f.name: coarse_type(f.dataType) for f in df.schema.fields}

    def as_text(pick, c: str) -> Column:
        if kinds[c] == "number":
            return pick(f"`{c}`").cast("double").cast("string")
        if kinds[c] == "date":
            return F.date_format(pick(f"`{c}`"), "yyyy-MM-dd HH:mm")
        return F.max(F.lit(None).cast("string"))

    facts = {
        "type": {c: F.max(F.lit(kinds[c])) for c in cols},
        "filled": {c: F.count(f"`{c}`") for c in cols},
        "distinct": {c: F.approx_count_distinct(f"`{c}`") for c in cols},
        "min": {c: as_text(F.min, c) for c in cols},
        "max": {c: as_text(F.max, c) for c in cols},
    }
    stats = _wide_to_long(df, cols, facts)
    if not columns_of(df, "text"):
        return stats.withColumn("top", F.lit(None).cast("array<struct<value:string,count:bigint>>"))
    tops = top_values(df).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))), lambda s: F.struct(s["value"], s["count"])).alias("top")
    )
    return stats.join(tops, "column", "left")
