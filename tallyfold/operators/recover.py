"""Type recovery: count which formats every column's text matches, decide, convert.

A column is converted only when every non-empty value parses, so no value is lost silently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import values as V
from tallyfold.session import stored

COUNTERS = [
    "n", "int", "lead0", "dot", "amb", "tr", "usk", "amb_comma", "comma_dec", "stripped",
    "iso_shape", "dmy_shape", "iso", "dmy", "mdy", "time", "frac_dot", "frac_comma",
]
KINDS = [
    "text", "integer", "decimal", "tr-number", "us-thousands", "iso-date", "dmy-date", "mdy-date",
]
_REPRESENTATION_CHANGED = ["tr-number", "us-thousands", "dmy-date", "mdy-date"]


def unpivot_text(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``(keys…, column, value)`` with one row per cell."""
    return df.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
        ])),
    )


def shape_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """How often each ``keys`` + column has each shape, over ``(keys…, column, value)`` rows, in one pass.

    Number texts and texts that look like a date are collapsed to their shape (every digit a 9, a number's leading zero kept): a column
    of any size has a handful of shapes, so the exact patterns run on shapes, not on cells, and the
    shuffle carries a few rows per column and task. A hot column or file is counted where its cells are. No cell is parsed.
    """
    v, s, m = F.col("v"), F.col("s"), F.col("m")
    value = cells.select(*keys, "column", V.present(F.col("value")).alias("v"))
    stripped = value.withColumn("s", V.strip_money(v)).withColumn("m", V.accounting_sign(s))

    # Only text that can be a date is looked at for one: figures with commas or one dot cannot.
    marks = F.translate(v, V.DIGITS, "")
    figures = V.only_chars(marks, ".,") & (marks.contains(",") | (F.length(marks) < 2))
    number = V.only_chars(m, V.NUMBER_CHARS)

    def collapsed(text: Column) -> Column:
        return F.translate(text, "012345678", "9" * 9)

    derived = stripped.select(
        *keys, "column", "v",
        (s != v).alias("noisy"),
        F.when(number, collapsed(m)).alias("shape"),
        F.ltrim(m, F.lit("+-")).startswith("0").alias("zero_led"),
        F.when(~number & F.right(m, F.lit(1)).between("0", "9"), F.regexp_extract(m, r"[.,]\d+\z", 0)).alias("tail"),
        F.when(~figures & V.date_like(v), collapsed(v)).alias("date_shape"),
    )
    return derived.groupBy(*keys, "column", "shape", "zero_led", "date_shape").agg(
        F.count("v").alias("n"),
        F.count_if("noisy").alias("stripped"),
        F.count_if(V.has_time(v)).alias("time"),
        _tail_digits(F.col("tail"), ".").alias("dot_tail"),
        _tail_digits(F.col("tail"), ",").alias("comma_tail"),
    )


def _tail_digits(text: Column, mark: str) -> Column:
    return F.max(F.when(F.startswith(text, F.lit(mark)), F.length(text) - 1))


def _counted(shaped: DataFrame, keys: list[str]) -> DataFrame:
    """The counters that shapes decide; ``iso_shape`` and ``dmy_shape`` count the values of a date's shape."""
    # A representative number of every shape: the leading zero is put back.
    typical = F.when(F.col("zero_led"), F.regexp_replace("shape", r"^([-+]*)9", "$10")).otherwise(F.col("shape"))
    shaped = shaped.withColumn("typical", typical).withColumn("shape_tail", F.regexp_extract("shape", r"[.,]\d+\z", 0)).withColumn(
        "day_first", V.dotted(F.col("date_shape"))).withColumn("year_first", V.dashed(F.col("date_shape")))

    def matching(text: str, pattern: str) -> Column:
        return F.coalesce(F.sum(F.when(V.full_match(F.col(text), pattern), F.col("n"))), F.lit(0))

    def digits(kept: str, mark: str) -> Column:
        longest = F.greatest(F.max(kept), _tail_digits(F.col("shape_tail"), mark))
        return F.coalesce(longest, F.lit(0)).cast("bigint")

    return shaped.groupBy(*keys, "column").agg(
        *[matching("typical", pattern).alias(name) for name, pattern in V.SHAPES.items()],
        *[F.sum(c).alias(c) for c in ("n", "stripped", "time")],
        matching("year_first", V.ISO_SHAPE).alias("iso_shape"),
        matching("day_first", V.DMY_SHAPE).alias("dmy_shape"),
        digits("dot_tail", ".").alias("frac_dot"),
        digits("comma_tail", ",").alias("frac_comma"),
    )


def _parsed_dates(cells: DataFrame, keys: list[str]) -> DataFrame:
    """How many values of ``(keys…, column, value)`` rows parse, per reading order; each distinct value is parsed once."""
    v = F.col("v")
    distinct = cells.select(*keys, "column", V.present(F.col("value")).alias("v")).where(v.isNotNull()).groupBy(*keys, "column", "v").agg(F.count("*").alias("n"))
    read = distinct.withColumn("year_first", F.when(v.rlike(r"^\d{4}[./-]\d"), V.dashed(v))).withColumn("day_first", F.when(F.col("year_first").isNull(), V.dotted(v)))
    readings = {"iso_ok": V.parse_iso(F.col("year_first")), "dmy_ok": V.parse_dmy(F.col("day_first")), "mdy_ok": V.parse_mdy(F.col("day_first"))}
    return read.groupBy(*keys, "column").agg(*[F.coalesce(F.sum(F.when(at.isNotNull(), F.col("n"))), F.lit(0)).alias(name) for name, at in readings.items()])


def profile_text(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Format counters of every text column, optionally per key (a file of a folder), in two stages.

    The first counts shapes. Dates are parsed only in columns whose every value has a date's shape, and there over distinct values:
    a parse count stands only for such columns, and month first only where day first failed.
    """
    keys = keys or []
    columns = columns or [c for c in df.columns if c not in keys]
    counted = stored(_counted(shape_counts(unpivot_text(df, columns, keys), keys), keys), "profile-shapes")
    whole = counted.where((F.col("n") > 0) & F.col("n").isin(F.col("iso_shape"), F.col("dmy_shape")))
    named = [r["column"] for r in whole.select("column").distinct().collect()]
    parsed = counted.select(*keys, "column", *[F.lit(0).cast("bigint").alias(c) for c in ("iso_ok", "dmy_ok", "mdy_ok")]).limit(0)
    if named:
        cells = unpivot_text(df, named, keys)
        if keys:
            dated = whole.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("column").alias("of_column"))
            same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in [*keys, "column"]]
            cells = cells.join(dated, same, "left_semi")
        parsed = stored(_parsed_dates(cells, keys), "profile-dates")
    both = parsed.select(*[F.col(k).alias(f"of_{k}") for k in [*keys, "column"]], "iso_ok", "dmy_ok", "mdy_ok")
    joined = counted.join(both, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in [*keys, "column"]], "left")
    n, dmy = F.col("n"), F.coalesce("dmy_ok", F.lit(0))
    whole_iso, whole_dmy = (n > 0) & (F.col("iso_shape") == n), (n > 0) & (F.col("dmy_shape") == n)
    return (
        joined.withColumn("iso", F.when(whole_iso, F.coalesce("iso_ok", F.lit(0))).otherwise(0))
        .withColumn("dmy", F.when(whole_dmy, dmy).otherwise(0))
        .withColumn("mdy", F.when(whole_dmy & (dmy < n), F.coalesce("mdy_ok", F.lit(0))).otherwise(0))
        .select(*keys, "column", *COUNTERS)
    )


def date_check(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How many values of each column truly parse as a date, per reading order."""
    return profile_text(df, columns).select("column", "n", "iso", "dmy", "mdy")


def decide(profile: DataFrame) -> DataFrame:
    """The kind of every profiled column with its flags; first matching rule wins."""
    c = {name: F.col(name) for name in COUNTERS}
    n = c["n"]
    plain = c["int"] + c["dot"]
    local = c["int"] + c["tr"]
    grouped = c["int"] + c["usk"] + c["dot"]
    unsure = (local == n) & (c["comma_dec"] > 0) & (c["amb_comma"] == c["comma_dec"])
    text = F.lit("text")
    rules = [
        (n == 0, text),
        (c["iso"] == n, F.lit("iso-date")),
        (c["dmy"] == n, F.lit("dmy-date")),
        (c["mdy"] == n, F.lit("mdy-date")),
        (c["lead0"] > 0, text),
        (c["int"] == n, F.lit("integer")),
        ((plain == n) & (c["dot"] > c["amb"]), F.lit("decimal")),
        (unsure, text),
        (local == n, F.lit("tr-number")),
        ((grouped == n) & (c["usk"] > 0), F.lit("us-thousands")),
    ]

    def chain(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
        out = F.when(*pairs[0])
        for condition, result in pairs[1:]:
            out = out.when(condition, result)
        return out.otherwise(otherwise)

    kind = chain(rules, text)
    before_unsure = [(cond, F.lit(False)) for cond, _ in rules[:7]]
    ambiguous = chain([*before_unsure, (unsure, F.lit(True))], F.lit(False))
    numeric = F.greatest(plain, local, grouped)
    blocked = F.when((n >= 5) & (numeric >= 0.8 * n), n - numeric).otherwise(0)
    unreadable = chain([(cond, F.lit(0).cast("bigint")) for cond, _ in rules], blocked)
    scale = (
        F.when(F.col("kind").isin("decimal", "us-thousands"), c["frac_dot"])
        .when(F.col("kind") == "tr-number", c["frac_comma"])
        .otherwise(0)
        .cast("int")
    )
    number = F.col("kind").isin("integer", "decimal", "tr-number", "us-thousands")
    return (
        profile.withColumn("kind", kind)
        .withColumn("ambiguous", ambiguous)
        .withColumn("unreadable", unreadable)
        .withColumn("scale", scale)
        .withColumn("with_time", F.col("kind").endswith("-date") & (c["time"] > 0))
        .withColumn("currency_stripped", number & (c["stripped"] > 0))
        .withColumn("converted", F.col("kind").isin(_REPRESENTATION_CHANGED) | F.col("currency_stripped"))
        .drop(*COUNTERS)
    )


@dataclass(frozen=True)
class Decision:
    """How one column is converted."""

    column: str
    kind: str
    scale: int = 0
    with_time: bool = False

    def prepared(self) -> Column:
        """First step: the text the conversion reads, so that it is computed once per cell."""
        c = F.col(f"`{self.column}`")
        if self.kind.endswith("-date"):
            return V.date_text(c, self.kind[:3])
        return V.present(c) if self.kind == "text" else V.money_text(V.present(c))

    def converted(self) -> Column:
        """Second step, on the prepared text."""
        c = F.col(f"`{self.column}`")
        if self.kind.endswith("-date"):
            return V.parse_date_text(c, self.kind[:3], self.with_time)
        return {
            "text": lambda: c,
            "integer": lambda: V.read_integer(c),
            "decimal": lambda: V.read_decimal(c, self.scale),
            "tr-number": lambda: V.read_comma_decimal(c, self.scale),
            "us-thousands": lambda: V.read_us_number(c, self.scale),
        }[self.kind]()


def collect_decisions(decisions: DataFrame) -> list[Decision]:
    """The decisions of one table on the driver: one small row per column, never per value."""
    rows = decisions.select("column", "kind", "scale", "with_time").collect()
    return [Decision(r["column"], r["kind"], r["scale"], r["with_time"]) for r in rows]


def convert(df: DataFrame, decisions: list[Decision]) -> DataFrame:
    """Every conversion in one pass over the rows; columns without a decision pass unchanged."""
    by_name = {d.column: d for d in decisions}

    def step(source: DataFrame, pick) -> DataFrame:
        return source.select(*[pick(by_name[c]).alias(c) if c in by_name else F.col(f"`{c}`") for c in source.columns])

    return step(step(df, Decision.prepared), Decision.converted)


def clean_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Profile, decide and convert an all-text table."""
    return convert(df, collect_decisions(decide(profile_text(df, columns))))


def cleaning_report(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """What the cleaning does to each column, for the reader of the result."""
    keys = keys or []
    return decide(profile_text(df, columns, keys)).select(
        *keys, "column", "kind", "converted", "currency_stripped", "unreadable", "ambiguous",
    )
