"""A first look at a table: what it adds up to, what leads, how months compare, and what to be wary of.

A share needs a whole without negative parts, and a month counts in a comparison only if the dates in
it reach from its start to its end.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.text import tr_lower
from tallyfold.operators import profile as P
from tallyfold.operators import quantiles as Z
from tallyfold.operators import query as Q
from tallyfold.operators.joins import is_id_like

# ---- fixed values: names, words and limits ------------------------------------------------------
MONEY_NAME = r"(tutar|ciro|fiyat|gelir|maliyet|gider|bakiye|borc|alacak|price|revenue|amount|cost|income|balance)"
NOT_MONEY = r"(adet|miktar|sayi|sayisi|count|qty|quantity|oran|yuzde|percent|rate)"
UNIT_PRICE = r"fiyat|price"
STATUS_WORDS = (
    "iade|iadeler|iptal|iptal edildi|red|reddedildi|return|returned|refund|refunded|cancel|cancelled|canceled|void|rejected"
)
DIM_MIN, DIM_MAX, STATUS_MAX = 2, 50, 8
EDGE_DAYS = 3
SPIKE_LIMIT, MAD_SCALE, SPIKE_MONTHS = 3.5, 1.4826, 6
OUTLIER_REACH, OUTLIER_SHARE = 3, 0.05
# ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Roles:
    """Which columns play the measure, the dimensions, the date and the possible statuses."""

    measure: str | None
    dims: tuple[str, ...]
    date: str | None
    statuses: tuple[str, ...] = ()


def pick_roles(df: DataFrame) -> Roles:
    """Choose by names and by one profile pass; the driver receives one small row per column."""
    import re

    cols = P.columns_of(df)
    row = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(f"`{c}`").alias(f"f{i}"), F.approx_count_distinct(f"`{c}`").alias(f"d{i}"))]).first()
    filled = {c: row[f"f{i}"] for i, c in enumerate(cols)}
    distinct = {c: row[f"d{i}"] for i, c in enumerate(cols)}
    money = [
        c for c in P.columns_of(df, "number")
        if not is_id_like(c) and re.search(MONEY_NAME, c.lower()) and not re.search(NOT_MONEY, c.lower()) and filled[c] > 0
    ]
    amounts = [c for c in money if not re.search(UNIT_PRICE, c)] + money
    texts = P.columns_of(df, "text")
    dates = P.columns_of(df, "date")
    return Roles(
        measure=amounts[0] if amounts else None,
        dims=tuple(c for c in texts if not is_id_like(c) and DIM_MIN <= distinct[c] <= DIM_MAX),
        date=dates[0] if dates else None,
        statuses=tuple(c for c in texts if DIM_MIN <= distinct[c] <= STATUS_MAX),
    )


def is_status_word(c: Column) -> Column:
    """A cancelled or returned status as a whole word."""
    return tr_lower(c).rlike(rf"(^|[^\p{{L}}])({STATUS_WORDS})([^\p{{L}}]|\z)")


def total(df: DataFrame, measure: str | None) -> DataFrame:
    """Rows, sum, negatives and filled cells in one pass."""
    if measure is None:
        return df.agg(F.count("*").alias("rows")).select(
            "rows", F.lit(None).cast("double").alias("total"), F.lit(0).cast("bigint").alias("negatives"), F.lit(0).cast("bigint").alias("filled")
        )
    m = F.col(measure)
    return df.agg(
        F.count("*").alias("rows"), F.sum(m).cast("double").alias("total"),
        F.count_if(m < 0).alias("negatives"), F.count(m).alias("filled"),
    )


def monthly_series(df: DataFrame, date: str, measure: str | None) -> DataFrame:
    """``(month, amount, lo, hi)``: the month's amount with the first and last day seen in it."""
    amount = F.sum(measure).cast("double") if measure else F.count("*").cast("double")
    day = F.dayofmonth(date)
    return df.filter(F.col(date).isNotNull()).groupBy(Q.period_text(F.col(date), "month").alias("month")).agg(
        amount.alias("amount"), F.min(day).alias("lo"), F.max(day).alias("hi")
    )


def _is_complete(month: Column, amount: Column, lo: Column, hi: Column) -> Column:
    days = F.day(F.last_day(F.to_date(F.concat(month, F.lit("-01")))))
    return (lo <= EDGE_DAYS) & (hi >= days - EDGE_DAYS) & amount.isNotNull()


def complete_months(months: DataFrame) -> DataFrame:
    """Months the data covers from (about) their first to their last day."""
    return months.filter(_is_complete(F.col("month"), F.col("amount"), F.col("lo"), F.col("hi")))


# The month logic works on one sorted array: there are only as many elements as months.


def _months_array(months: DataFrame) -> DataFrame:
    return months.agg(F.array_sort(F.collect_list(F.struct("month", "amount", "lo", "hi"))).alias("months"))


def _complete(months: Column) -> Column:
    return F.filter(months, lambda m: _is_complete(m["month"], m["amount"], m["lo"], m["hi"]))


def _best(complete: Column) -> Column:
    ranked = F.array_sort(F.transform(complete, lambda m: F.struct((-m["amount"]).alias("k"), m["month"].alias("month"))))
    best = F.get(ranked, F.lit(0))
    return F.when(F.size(complete) >= 2, F.struct(best["month"].alias("month"), (-best["k"]).alias("amount")))


def _trend(complete: Column) -> Column:
    first, last = F.get(complete, F.lit(0)), F.get(complete, F.size(complete) - 1)
    return F.when(
        (F.size(complete) >= 3) & (first["amount"] > 0),
        F.struct(
            first["month"].alias("from"), last["month"].alias("to"),
            ((last["amount"] - first["amount"]) / first["amount"]).alias("change"),
        ),
    )


def _upper_median(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def _spikes(complete: Column) -> Column:
    amounts = F.transform(complete, lambda m: m["amount"])
    median = _upper_median(amounts)
    spread = _upper_median(F.transform(amounts, lambda a: F.abs(a - median))) * MAD_SCALE
    found = F.transform(
        F.filter(complete, lambda m: F.try_divide(F.abs(m["amount"] - median), spread) > SPIKE_LIMIT),
        lambda m: F.struct(m["month"].alias("month"), m["amount"].alias("amount"), median.alias("median"), (m["amount"] > median).alias("high")),
    )
    return F.when((F.size(complete) >= SPIKE_MONTHS) & (spread > 0), found)


def best_month(months: DataFrame) -> DataFrame:
    row = _months_array(months).select(_best(_complete(F.col("months"))).alias("m")).filter(F.col("m").isNotNull())
    return row.select("m.month", "m.amount")


def month_trend(months: DataFrame) -> DataFrame:
    row = _months_array(months).select(_trend(_complete(F.col("months"))).alias("m")).filter(F.col("m").isNotNull())
    return row.select("m.from", "m.to", "m.change")


def month_spikes(months: DataFrame) -> DataFrame:
    """Months far from the median in units of the median deviation; needs six complete months."""
    return _months_array(months).select(F.inline(_spikes(_complete(F.col("months")))))


def top_share(df: DataFrame, dims: list[str], measure: str | None) -> DataFrame:
    """Leading value of the first two dimensions; nothing where a negative would spoil the shares."""
    return _summary(df, Roles(measure, tuple(dims[:2]), None)).select(F.inline(_tops(dims[:2], measure))).select(
        F.col("subject").alias("dim"), "value", "amount", "share"
    )


def status_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Records in a cancelled or returned status, for the first column that has one."""
    found = _summary(df, Roles(None, (), None, tuple(columns))).select(F.inline(F.array(_status(columns))))
    return found.filter(F.col("value").isNotNull()).select(F.col("subject").alias("column"), "value", "rows", "share")


def outliers_iqr(df: DataFrame, measure: str) -> DataFrame:
    """Values beyond Q3 + 3·IQR when they are rare; a skewed column full of them is no anomaly."""
    m = F.col(measure).cast("double")
    q = Z.exact_quantiles(df, measure, [0.25, 0.5, 0.75])
    fence = q.select((F.col("q2") + OUTLIER_REACH * (F.col("q2") - F.col("q0"))).alias("fence")).scalar()
    spread = q.select((F.col("q2") > F.col("q0")).alias("spread")).scalar()
    row = df.agg(F.count("*").alias("rows"), F.count_if(m > fence).alias("count"), F.max(F.when(m > fence, m)).alias("max"))
    kept = row.filter(spread & (F.col("count") > 0) & (F.col("count") <= OUTLIER_SHARE * F.col("rows")))
    return kept.select("count", "max", q.select("q1").scalar().alias("median"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; what is moved is a 256-bit digest per row, not the row."""
    plain = [F.when(F.col(f"`{f.name}`") == 0, F.lit(0).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    digest = F.unhex(F.sha2(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}), 256))
    return df.select(digest.alias("digest")).groupBy("digest").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


# ---- the assembled first look ------------------------------------------------------------------------


def _summary(df: DataFrame, roles: Roles) -> DataFrame:
    """One row with every small total the findings need, from a single pass.

    Each record is counted once for the whole table and once per dimension, status column and month;
    all of it collapses in the tasks before anything is shuffled.
    """
    subjects = [("all", F.lit(None).cast("string"))]
    # A column that is a dimension and a status counts its records once.
    subjects += [(f"column:{c}", F.col(f"`{c}`").cast("string")) for c in dict.fromkeys((*roles.dims, *roles.statuses))]
    day = F.lit(None).cast("int")
    if roles.date:
        subjects.append(("month", Q.period_text(F.col(roles.date), "month")))
        day = F.dayofmonth(roles.date)
    measure = F.col(roles.measure) if roles.measure else F.lit(1).cast("bigint")
    spread = df.select(
        measure.alias("m"), day.alias("day"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in subjects])),
    )
    groups = spread.filter(F.col("value").isNotNull() | (F.col("kind") == "all")).groupBy("kind", "value").agg(
        F.count("*").alias("n"), F.sum("m").cast("double").alias("amount"), F.count_if(F.col("m") < 0).alias("neg"),
        F.count("m").alias("filled"), F.min("day").alias("lo"), F.max("day").alias("hi"),
    )

    def only(kind: str, c: Column) -> Column:
        return F.when(F.col("kind") == kind, c)

    aggs = [
        F.max(only("all", F.col("n"))).alias("rows"), F.max(only("all", F.col("amount"))).alias("total"),
        F.max(only("all", F.col("neg"))).alias("negatives"), F.max(only("all", F.col("filled"))).alias("filled"),
        F.array_sort(F.collect_list(only("month", F.struct(F.col("value").alias("month"), "amount", "lo", "hi")))).alias("months"),
    ]
    leader = F.struct("value", "amount")
    for i, c in enumerate(roles.dims):
        ahead = (F.col("kind") == f"column:{c}") & (F.col("amount") > 0)
        aggs.append(F.min_by(leader, F.when(ahead, F.struct(-F.col("amount"), F.col("value")))).alias(f"dim_{i}"))
    for i, c in enumerate(roles.statuses):
        hit = (F.col("kind") == f"column:{c}") & is_status_word(F.col("value"))
        aggs.append(F.min_by(F.struct("value", "n"), F.when(hit, F.struct(-F.col("n"), F.col("value")))).alias(f"status_{i}"))
    return groups.agg(*aggs)


def _finding(kind: str, subject, value=None, amount=None, share=None, rows=None) -> Column:
    def typed(x, t: str) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast(t)

    return F.struct(
        F.lit(kind).alias("kind"), typed(subject, "string").alias("subject"), typed(value, "string").alias("value"),
        typed(amount, "double").alias("amount"), typed(share, "double").alias("share"), typed(rows, "bigint").alias("rows"),
    )


def _tops(dims, measure: str | None) -> Column:
    whole = F.col("total") if measure else F.col("rows").cast("double")
    fair = (whole > 0) & ((F.col("negatives") == 0) if measure else F.lit(True))
    found = [
        _finding("top", dim, F.col(f"dim_{i}")["value"], F.col(f"dim_{i}")["amount"], F.col(f"dim_{i}")["amount"] / whole)
        for i, dim in enumerate(dims)
    ]
    empty = F.filter(F.array(_finding("top", None)), lambda _: F.lit(False))
    return F.when(fair, F.filter(F.array(*found), lambda f: f["value"].isNotNull())).otherwise(empty) if found else empty


def _status(columns) -> Column:
    first = F.coalesce(*[
        F.when(F.col(f"status_{i}").isNotNull(), F.struct(
            F.lit(c).alias("column"), F.col(f"status_{i}")["value"].alias("value"), F.col(f"status_{i}")["n"].alias("n")))
        for i, c in enumerate(columns)
    ])
    return _finding("status", first["column"], first["value"], None, first["n"] / F.col("rows"), first["n"])


def overview(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """``(seq, kind, subject, value, amount, share, rows)``: findings first, then warnings."""
    roles = roles or pick_roles(df)
    measure = roles.measure
    s = _summary(df, replace(roles, dims=roles.dims[:2]))
    empty = F.filter(F.array(_finding("total", None)), lambda _: F.lit(False))
    done = F.col("complete")
    s = s.filter(F.col("rows") > 0).withColumn("complete", _complete(F.col("months")))
    s = s.withColumn("best", _best(done)).withColumn("trend", _trend(done)).withColumn("spikes", _spikes(done))
    findings = [
        F.array(_finding("total", measure, None, F.col("total") if measure else F.col("rows"), None, F.col("rows"))),
        _tops(roles.dims[:2], measure),
        F.when(F.col("best").isNotNull(), F.array(_finding("best_month", measure, F.col("best.month"), F.col("best.amount")))).otherwise(empty),
        F.when(F.col("trend").isNotNull(), F.array(_finding(
            "trend", F.col("trend.from"), F.col("trend.to"), None, F.col("trend.change")))).otherwise(empty),
    ]
    if roles.statuses:
        findings.append(F.filter(F.array(_status(roles.statuses)), lambda f: f["value"].isNotNull()))
    spikes = F.coalesce(F.transform(F.col("spikes"), lambda x: _finding("month_spike", measure, x["month"], x["amount"], None)), empty)
    few = (F.col("negatives") > 0) & (F.col("negatives") < 0.5 * F.col("filled"))
    negatives = F.when(few, F.array(_finding("negatives", measure, None, None, None, F.col("negatives")))).otherwise(empty)
    early = s.select(F.posexplode(F.concat(*findings, spikes)).alias("seq", "f"))
    parts = [early.select("seq", "f.*")]
    if measure:
        out = outliers_iqr(df, measure)
        parts.append(out.select(F.lit(1000).alias("seq"), _finding("outliers", measure, None, F.col("max"), None, F.col("count")).alias("f")).select("seq", "f.*"))
        parts.append(s.select(F.inline(negatives)).select(F.lit(1001).alias("seq"), "*"))
    dup = duplicate_count(df).filter(F.col("duplicates") > 0)
    parts.append(dup.select(F.lit(1002).alias("seq"), _finding("duplicates", None, None, None, None, F.col("duplicates")).alias("f")).select("seq", "f.*"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    # A handful of rows: warnings are numbered on from the findings before them.
    place = (F.row_number().over(Window.orderBy("seq")) - 1).alias("seq")
    return result.select(place, *result.columns[1:]).orderBy("seq")
