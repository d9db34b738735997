"""The business-question patterns: filters, periods, ratios, rankings, shares and series.

Everything composes on plain DataFrames. One-row facts (the latest month, a total, a threshold)
enter the plan as scalar subqueries, which run once and reach the scan as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.text import fold_python, fold_text

# ---- fixed values --------------------------------------------------------------------------
BOOLEAN_WORDS = ("Evet", "Hayır")
DEFAULT_TOP_N = 10
MAX_SERIES = 8
# --------------------------------------------------------------------------------------------


class DuplicateColumn(ValueError):
    """A result may not have two columns of one name."""


class MissingColumn(ValueError):
    """The question needs a column the table does not have; nothing is invented for it."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumn(f"no such column: {', '.join(missing)}")
    return df


def require_unique_names(df: DataFrame) -> DataFrame:
    seen: set[str] = set()
    for name in df.columns:
        if name in seen:
            raise DuplicateColumn(f"column name used twice: {name}")
        seen.add(name)
    return df


def project(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    """Named expressions; a repeated name is an error."""
    return require_unique_names(df.select(*[c.alias(name) for name, c in columns]))


def normalize_result(df: DataFrame, words: tuple[str, str] = BOOLEAN_WORDS) -> DataFrame:
    """Only DOUBLE and STRING columns: numbers, and everything else as readable text."""
    require_unique_names(df)

    def plain(field: T.StructField) -> Column:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, T.NumericType):
            return c.cast("double")
        if isinstance(t, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm")
        if isinstance(t, T.BooleanType):
            return F.when(c, F.lit(words[0])).when(~c, F.lit(words[1]))
        if isinstance(t, T.StringType):
            return c
        if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c)
        return c.cast("string")

    return df.select(*[plain(f).alias(f.name) for f in df.schema.fields])


# ---- periods ---------------------------------------------------------------------------------


def _start_of(df: DataFrame, date: str, unit: str, months_back: int = 0) -> Column:
    start = F.trunc(F.max(date), unit)
    if months_back:
        start = F.add_months(start, -months_back)
    return df.agg(start.cast(df.schema[date].dataType).alias("start")).scalar()


def latest_period(df: DataFrame, date: str, unit: str) -> DataFrame:
    """Rows of the latest month or year that the data has (not of the wall clock)."""
    return df.filter(F.col(date) >= _start_of(df, date, unit))


def previous_period(df: DataFrame, date: str, unit: str = "month") -> DataFrame:
    """Rows of the period just before the latest one."""
    back = {"month": 1, "quarter": 3, "year": 12}[unit]
    return df.filter((F.col(date) >= _start_of(df, date, unit, back)) & (F.col(date) < _start_of(df, date, unit)))


def last_n_days(df: DataFrame, date: str, days: int) -> DataFrame:
    """Exactly ``days`` days, the latest one included."""
    after = df.agg((F.max(date) - F.make_dt_interval(F.lit(days))).alias("after")).scalar()
    return df.filter(F.col(date) > after)


def period_text(date: Column, unit: str) -> Column:
    """The period of a date as sortable text; a week is named by its Monday."""
    shape = {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit]
    return F.date_format(date.cast("date") if unit == "day" else F.trunc(date, unit), shape)


def is_weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def day_name(date: Column, names: list[str]) -> Column:
    """Name of the weekday, Monday first."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(date) + 1)


# ---- text and thresholds ---------------------------------------------------------------------


def contains_stem(c: Column, stem: str) -> Column:
    """Case- and accent-blind search for a word stem, as suffixes change the last letters."""
    return F.contains(fold_text(c), F.lit(fold_python(stem)))


def match_key(c: Column) -> Column:
    """Join key whose spelling differs between tables."""
    return F.lower(F.trim(c))


def safe_ratio(a: Column, b: Column) -> Column:
    """Quotient as DOUBLE, null on a zero or missing denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_of(part: Column, whole: Column) -> Column:
    """Share on the 0–100 scale, not rounded."""
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def bucket_ranges(c: Column, bounds: list[float], labels: list[str]) -> Column:
    """``labels[i]`` for values up to ``bounds[i]`` (inclusive), the last label above all bounds."""
    out = F.when(c.isNull(), None)
    for bound, label in zip(bounds, labels):
        out = out.when(c <= bound, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def strict_number(c: Column, kind: str = "decimal(38,10)") -> Column:
    """A number for use inside an aggregate: text that is none fails the query instead of vanishing."""
    number = c.try_cast(kind)
    return F.when(c.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), c)).cast(kind)).otherwise(number)


def precise_sum(c: Column) -> Column:
    """Sum of doubles that does not drift, whatever their size.

    Numbers below 1e17 are summed exactly to ten decimals with the remainder beside them, whole numbers below 1e27 exactly,
    larger ones as doubles. A value that is not finite makes the sum what plain addition makes it.
    """
    size = F.abs(c)
    fine, whole = F.when(size < 1e17, c), F.when((size >= 1e17) & (size < 1e27), c)
    exact = fine.cast("decimal(38,10)")
    parts = [F.sum(exact).cast("double"), F.sum(fine - exact.cast("double")), F.sum(whole.cast("decimal(38,0)")).cast("double"), F.sum(F.when((size >= 1e27) | F.isnan(c), c))]
    large_first = F.coalesce(parts[3], F.lit(0.0)) + F.coalesce(parts[2], F.lit(0.0))
    return F.when(F.count(c) > 0, large_first + (F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0))))


# ---- rankings, shares and series over grouped results ------------------------------------------


def top_n(df: DataFrame, value: str, tie: list[str], n: int = DEFAULT_TOP_N, descending: bool = True) -> DataFrame:
    """The first ``n`` rows by value; ties in a fixed order. Each task keeps only ``n`` rows."""
    lead = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return df.orderBy(lead, *[F.col(t).asc() for t in tie]).limit(n)


def grouped_total(df: DataFrame, dim: str, measure: Column, name: str = "amount") -> DataFrame:
    """Null groups left out; a group without any value counts as zero."""
    return df.filter(F.col(dim).isNotNull()).groupBy(dim).agg(F.coalesce(F.sum(measure), F.lit(0)).alias(name))


def whole_of(grouped: DataFrame, value: str) -> Column:
    """The total over all groups as a scalar, so that no single task sees every group."""
    return grouped.agg(F.sum(value).alias("whole")).scalar()


def share_of_total(grouped: DataFrame, value: str, name: str = "share") -> DataFrame:
    return grouped.withColumn(name, percent_of(F.col(value), whole_of(grouped, value)))


def top_k_share(grouped: DataFrame, value: str, tie: list[str], k: int) -> DataFrame:
    """One row: what the ``k`` largest groups hold of the whole."""
    top = top_n(grouped, value, tie, k).agg(F.sum(value).alias("top"))
    return top.select("top", whole_of(grouped, value).alias("whole")).withColumn(
        "share", percent_of(F.col("top"), F.col("whole"))
    )


def cumulative(series: DataFrame, period: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Running total over the periods. ``series`` is aggregated already: one row per period."""
    w = Window.partitionBy(*(by or [])).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("cumulative", F.sum(value).over(w))


def period_change(series: DataFrame, period: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Previous value and percent change per period; null without a previous or on a zero base."""
    w = Window.partitionBy(*(by or [])).orderBy(period)
    return series.withColumn("previous", F.lag(value).over(w)).withColumn(
        "change_pct", percent_of(F.col(value) - F.col("previous"), F.col("previous"))
    )


def limit_series(series: DataFrame, name: str, value: str, keep: int = MAX_SERIES) -> DataFrame:
    """Only the rows of the ``keep`` largest series (by the sum of absolute values)."""
    totals = series.groupBy(name).agg(F.sum(F.abs(value)).alias("total"))
    largest = top_n(totals, "total", [name], keep).select(name)
    return series.join(largest, name, "left_semi")


def extreme_facts(df: DataFrame, item: str, measures: list[tuple[str, Column]]) -> DataFrame:
    """For each named measure its winning item: small table ``(criterion, item, value)``."""
    grouped = df.groupBy(item).agg(*[measure.alias(f"m{i}") for i, (_, measure) in enumerate(measures)])
    # Highest first, missing values last, ties by the item.
    best = grouped.agg(F.count("*").alias("items"), *[
        F.min_by(F.struct(F.col(item).alias("item"), F.col(f"m{i}").cast("double").alias("value")), F.struct(F.col(f"m{i}").isNull(), -F.col(f"m{i}"), F.col(item))).alias(f"b{i}")
        for i in range(len(measures))
    ])
    rows = F.array(*[F.struct(F.lit(label).alias("criterion"), F.col(f"b{i}.item").alias("item"), F.col(f"b{i}.value").alias("value")) for i, (label, _) in enumerate(measures)])
    return best.filter(F.col("items") > 0).select(F.inline(rows))
