"""Joins that cannot double count: every side is aggregated to the key before it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.text import fold_python
from tallyfold.operators.query import percent_of

# ---- fixed values: last words of names that identify rather than describe ----------------------
ID_WORDS = [
    "no", "nr", "id", "kod", "kodu", "code", "numara", "numarasi", "number", "sira", "index", "idx",
    "sn", "uuid", "ref",
]
# ------------------------------------------------------------------------------------------------


class NoSharedKey(ValueError):
    """The tables have no text column in common, so they cannot be combined."""


def is_id_like(name: str) -> bool:
    """Whether a column's name says that it numbers things rather than measuring or naming them."""
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in fold_python(name)).split()
    return bool(words) and (words[-1] in ID_WORDS or "".join(words) in ID_WORDS)


def shared_text_keys(main: DataFrame, other: DataFrame) -> list[str]:
    """Text columns of the same name on both sides that describe a category."""
    texts = {f.name for f in other.schema.fields if isinstance(f.dataType, T.StringType)}
    keys = [
        f.name for f in main.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name in texts and not is_id_like(f.name)
    ]
    if not keys:
        raise NoSharedKey("the tables share no text column to join on")
    return keys


def safe_join(
    main: DataFrame,
    other: DataFrame,
    key: str | tuple[Column, Column] | None = None,
    main_aggs: list[Column] | None = None,
    other_aggs: list[Column] | None = None,
    how: str = "left",
    name: str = "key",
) -> DataFrame:
    """Aggregate both tables to the key, then join one row to one row.

    ``key`` is a shared column name, or a pair of expressions where the spelling or the type differs
    between the tables. Rows of the main table are never lost (left join) and never multiplied, and
    the shuffles carry one partial row per key and task, so a hot key costs no more than any other.
    """
    if key is None:
        key = shared_text_keys(main, other)[0]
    if isinstance(key, str):
        name, left_key, right_key = key, F.col(key), F.col(key)
    else:
        left_key, right_key = key
    left = main.groupBy(left_key.alias(name)).agg(*(main_aggs or [F.count("*").alias("rows")]))
    right = other.groupBy(right_key.alias(name)).agg(*(other_aggs or [F.count("*").alias("other_rows")]))
    return left.join(right, name, how)


def attainment(joined: DataFrame, actual: str, target: str, name: str = "attainment") -> DataFrame:
    """Actual against target on the 0–100 scale; without a target it stays null."""
    return joined.withColumn(name, percent_of(F.col(actual), F.col(target)))


def met_target(joined: DataFrame, actual: str, target: str, met: bool = True) -> DataFrame:
    """Only the keys that reached (or missed) their target."""
    reached = F.col(actual) >= F.col(target)
    return joined.filter(reached if met else ~reached)


def fanout(main: DataFrame, other: DataFrame, key: str, value: Column) -> DataFrame:
    """What joining the raw rows would do to each key's total, without building those rows.

    ``factor`` is how often every main row would be repeated; a factor above one is a trap.
    """
    left = main.groupBy(key).agg(F.sum(value).alias("true_total"), F.count("*").alias("rows"))
    right = other.groupBy(key).agg(F.count("*").alias("factor"))
    return left.join(right, key).select(
        key, "true_total", "factor", (F.col("rows") * F.col("factor")).alias("joined_rows"),
        (F.col("true_total") * F.col("factor")).alias("inflated_total"),
    )


def in_first_not_second(df: DataFrame, item: str, first: Column, second: Column) -> DataFrame:
    """Items seen under one condition and never under the other; one aggregated pass."""
    seen = df.filter(first | second).groupBy(item).agg(F.bool_or(first).alias("a"), F.bool_or(second).alias("b"))
    return seen.filter(F.col("a") & ~F.col("b")).select(item)


def same_items(df: DataFrame, selected: DataFrame, item: str) -> DataFrame:
    """Rows of the items an earlier question selected."""
    return df.join(selected.select(item), item, "left_semi")
