"""Writing results: delimited text for spreadsheets, typed files, and bounded previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.query import normalize_result

# ---- fixed values -----------------------------------------------------------------------------------
SEPARATORS = {"tr": ";", "en": ","}
DECIMALS = {"currency": 2, "percent": 2, "integer": 0, "number": 4, "text": 4, "date": 4, "month": 4}
FORMULA_START = r"^[=+\-@\t\r]"
MAX_RESULT_ROWS = 10_000
PREVIEW_ROWS = 20
BYTE_ORDER_MARK = "﻿"
# -----------------------------------------------------------------------------------------------------


def formula_guard(c: Column) -> Column:
    """Text a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def number_text(c: Column, decimals: int, locale: str) -> Column:
    """At most ``decimals`` decimals, rounded half away from zero, no grouping, no trailing zeros."""
    # A number beyond the decimal type keeps its plain form instead of failing the export.
    text = F.coalesce(c.try_cast(f"decimal(38,{decimals})").cast("string"), c.cast("string"))
    short = F.when(text.contains("E"), text).otherwise(F.regexp_replace(text, r"\.?0+\z", "")) if decimals else text
    return F.replace(short, F.lit("."), F.lit(",")) if locale == "tr" else short


def export_format(df: DataFrame, formats: dict[str, str] | None = None, locale: str = "tr") -> DataFrame:
    """Every column as the text a spreadsheet of that language reads back."""
    plain, formats = normalize_result(df), formats or {}

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            return number_text(c, DECIMALS[formats.get(f.name, "number")], locale)
        return formula_guard(c)

    return plain.select(*[cell(f).alias(f.name) for f in plain.schema.fields])


def export_csv(
    df: DataFrame, path: str, formats: dict[str, str] | None = None, labels: dict[str, str] | None = None,
    locale: str = "tr", sep: str | None = None, bom: bool = True,
) -> None:
    """The whole result as delimited files, each with header, CRLF and (if wanted) a byte-order mark."""
    text, labels = export_format(df, formats, locale), labels or {}
    names = [labels.get(c, c) for c in text.columns]
    names = ["'" + n if n[:1] in "=+-@\t\r" and n else n for n in names]
    if bom and names:
        names[0] = BYTE_ORDER_MARK + names[0]
    text.toDF(*names).write.mode("overwrite").csv(
        path, header=True, sep=sep or SEPARATORS[locale], lineSep="\r\n", quote='"', escape='"', nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def export_typed(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """Parquet with real types: numbers stay numbers, date text becomes dates; the format is kept as a comment."""
    formats = formats or {}

    def typed(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), formats.get(f.name)
        if kind in ("date", "month") and isinstance(f.dataType, T.StringType):
            c = c.try_cast("timestamp_ntz" if kind == "date" else "date")
        return c.alias(f.name, metadata={"comment": kind} if kind else {})

    df.select(*[typed(f) for f in df.schema.fields]).write.mode("overwrite").parquet(path)


def bounded_fetch(df: DataFrame, *order, limit: int = MAX_RESULT_ROWS) -> DataFrame:
    """The first ``limit`` rows in the given order with a flag that says whether there are more.

    One row more than wanted is looked at; the full result is for the export, which has no limit here.
    """
    more = df.limit(limit + 1).agg((F.count("*") > limit).alias("partial")).scalar()
    return df.orderBy(*order).limit(limit).withColumn("partial", more)


def preview(df: DataFrame, *order) -> DataFrame:
    """The first rows in a fixed order, as plain numbers and text."""
    return normalize_result(df.orderBy(*order).limit(PREVIEW_ROWS))
