"""Tidying messy sheets, a whole folder of them at a time.

Input: ``(file_id, row_idx, cells ARRAY<STRING>)``; ``row_idx`` is any orderable position in the file,
empty cells are null. Facts about a file (width, header, kept columns) are small tables joined back,
so a file may hold any share of the rows; only the first twenty rows of a file ever meet in one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyfold.functions.text import fold_python, fold_text, header_like, value_like
from tallyfold.session import stored

# ---- fixed values: limits and labels ------------------------------------------------------------------
HEADER_SCAN_ROWS = 15
ROWS_AFTER_HEADER = 5
GHOST_EMPTY_SHARE = 0.9
MIN_HEADER_SCORE = 0.2
SCORE_MARGIN = 1e-9
TOTAL_LABELS = [
    "toplam", "genel toplam", "ara toplam", "toplamlar", "genel ortalama", "ortalama",
    "total", "totals", "grand total", "sub total", "subtotal", "sum", "average", "avg", "mean",
]
NAME_LENGTH = 60
LABEL_LENGTH = 40
GENERATED_PREFIX = "col"
# -------------------------------------------------------------------------------------------------------

_SEPARATOR = "\u0000"


def present_cells(cells: Column) -> Column:
    return F.filter(cells, lambda c: c.isNotNull())


def filled_count(cells: Column) -> Column:
    return F.size(present_cells(cells))


def last_filled(cells: Column) -> Column:
    """1-based index of the last filled cell, 0 for an empty row."""
    return F.coalesce(F.array_max(F.transform(cells, lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0))), F.lit(0))


def file_widths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id").agg(F.max(last_filled(F.col("cells"))).alias("width"))


def padded(cells: Column, width: Column) -> Column:
    """The first ``width`` cells, missing ones null."""
    missing = F.array_repeat(F.lit(None).cast("string"), F.greatest(width - F.size(cells), F.lit(0)))
    return F.slice(F.concat(cells, missing), F.lit(1), width)


def pad_rows(rows: DataFrame) -> DataFrame:
    """Every row as wide as its file."""
    wide = rows.join(file_widths(rows), "file_id")
    return wide.withColumn("cells", padded(F.col("cells"), F.col("width"))).drop("width")


def row_key(cells: Column) -> Column:
    """Folded text of all cells, for comparing whole rows."""
    return fold_text(F.array_join(cells, _SEPARATOR, ""))


def total_label(cells: Column) -> Column:
    """The label of a summary row: a total or average word alone, every other filled cell a value.

    Only a short first cell with a letter can be such a word; the others are not folded.
    """
    present = present_cells(cells)
    first = F.get(present, F.lit(0))
    likely = (F.length(first) <= LABEL_LENGTH) & first.rlike(r"\p{L}")
    word = F.regexp_replace(F.regexp_replace(fold_text(first), r"[:.\s]+\z", ""), r"\s+", " ")
    others = F.slice(present, F.lit(2), F.greatest(F.size(present), F.lit(1)))
    return F.when(likely, F.when(word.isin(TOTAL_LABELS), F.when(F.forall(others, value_like), first)))


def detect_header(rows: DataFrame) -> DataFrame:
    """``(file_id, width, header_pos, header_idx, header)``: position (from 1), place and cells of the header row.

    Among the first rows the header is wide, textual and unique, and rows of similar width follow it.
    Without such a row ``header_pos`` is 0 and the header holds nulls.
    """
    by_file = Window.partitionBy("file_id").orderBy("row_idx")
    scanned = HEADER_SCAN_ROWS + ROWS_AFTER_HEADER
    # The rank limit is applied per task before files meet, so a large file sends only its first rows.
    head = rows.withColumn("pos", F.row_number().over(by_file)).filter(F.col("pos") <= scanned)
    head = head.join(file_widths(rows), "file_id").withColumn("cells", padded(F.col("cells"), F.col("width")))
    head = head.withColumn("filled", filled_count(F.col("cells")))
    after = Window.partitionBy("file_id").orderBy("pos").rowsBetween(1, ROWS_AFTER_HEADER)
    head = head.withColumn("next", F.avg(F.when(F.col("filled") > 0, F.col("filled"))).over(after))
    present = present_cells(F.col("cells"))
    textual = F.size(F.filter(present, header_like)) / F.col("filled")
    unique = F.size(F.array_distinct(F.transform(present, fold_text))) / F.col("filled")
    follows = F.when(F.col("next") >= 0.5 * F.col("filled"), 1.0).otherwise(0.3)
    possible = (
        (F.col("pos") <= HEADER_SCAN_ROWS) & (F.col("filled") > 0)
        & (F.col("filled") >= F.least(F.lit(2), F.col("width"))) & (textual >= 0.5)
    )
    score = F.when(possible, F.col("filled") / F.col("width") * textual * unique * follows)
    ranked = head.withColumn("score", score).groupBy("file_id").agg(
        F.max("width").alias("width"),
        F.array_sort(F.collect_list(F.struct("pos", "score", "row_idx", "cells"))).alias("rows"),
    )
    start = F.struct(F.lit(0).alias("pos"), F.lit(0.0).alias("score"))
    best = F.aggregate(
        "rows", start,
        lambda acc, r: F.when(
            F.coalesce(r["score"], F.lit(0.0)) > acc["score"] + SCORE_MARGIN,
            F.struct(r["pos"].alias("pos"), r["score"].alias("score")),
        ).otherwise(acc),
    )
    ranked = ranked.withColumn("best", best).withColumn(
        "header_pos", F.when(F.col("best.score") >= MIN_HEADER_SCORE, F.col("best.pos")).otherwise(0)
    )
    nothing = F.array_repeat(F.lit(None).cast("string"), F.col("width"))
    line = F.get(F.col("rows"), F.col("header_pos") - 1)
    return ranked.select(
        "file_id", "width", "header_pos", F.when(F.col("header_pos") > 0, line["row_idx"]).alias("header_idx"),
        F.when(F.col("header_pos") > 0, line["cells"]).otherwise(nothing).alias("header"),
    )


def _with_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files, "file_id")


def classify_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows below the header, padded, each with its fate: ``empty``, ``total``, ``repeat`` or ``data``."""
    named = F.col("header_pos") > 0
    info = files.select("file_id", "width", "header_idx", F.when(named, row_key(F.col("header"))).alias("header_key"),
                        F.when(named, filled_count(F.col("header"))).alias("header_filled"),
                        F.when(named, fold_text(F.get(present_cells(F.col("header")), F.lit(0)))).alias("header_first"))
    below = rows.join(info, "file_id").filter(
        F.col("header_idx").isNull() | (F.col("row_idx") > F.col("header_idx"))
    )
    below = below.withColumn("cells", padded(F.col("cells"), F.col("width")))
    labelled = below.withColumn("label", total_label(F.col("cells"))).withColumn("filled", filled_count(F.col("cells")))
    # A repeated header is rare: its number of filled cells and its first cell are compared before whole rows are folded.
    first = F.get(present_cells(F.col("cells")), F.lit(0))
    alike = F.when(F.col("filled") == F.col("header_filled"), F.when(fold_text(first) == F.col("header_first"), row_key(F.col("cells")) == F.col("header_key")))
    fate = (
        F.when(F.col("filled") == 0, "empty")
        .when(F.col("label").isNotNull(), "total")
        .when(F.coalesce(alike, F.lit(False)), "repeat")
        .otherwise("data")
    )
    return labelled.withColumn("fate", fate).select("file_id", "row_idx", "cells", "label", "fate")


def drop_empty_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(filled_count(F.col("cells")) > 0)


def drop_total_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(total_label(F.col("cells")).isNull())


def drop_repeated_headers(rows: DataFrame, files: DataFrame) -> DataFrame:
    return classify_rows(rows, files).filter(F.col("fate") != "repeat").select("file_id", "row_idx", "cells")


def kept_columns(data: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, kept ARRAY<INT>, dropped)``: columns that are not ghosts.

    A column without any value is dropped, and one without a name that is more than 90 % empty; a
    named sparse column is real data.
    """
    # Rows of a file are filled in a few patterns; those are counted, and only the patterns are laid out by column.
    pattern = F.array_join(F.transform("cells", lambda c: F.when(c.isNull(), "0").otherwise("1")), "")
    patterns = data.groupBy("file_id", pattern.alias("pattern")).agg(F.count("*").alias("n"))
    counts = patterns.select("file_id", "n", F.posexplode(F.filter(F.split("pattern", ""), lambda p: p != "")).alias("c", "p")).groupBy("file_id", "c").agg(
        F.sum(F.when(F.col("p") == "1", F.col("n")).otherwise(0)).alias("values"), F.sum("n").alias("rows")
    )
    columns = files.select("file_id", F.posexplode("header").alias("c", "name")).join(counts, ["file_id", "c"], "left")
    rows, values = F.coalesce("rows", F.lit(0)), F.coalesce("values", F.lit(0))
    share = F.when(rows > 0, 1 - values / rows).otherwise(F.when(F.col("name").isNull(), 1.0).otherwise(0.0))
    keep = ~((values == 0) & (rows > 0)) & ~(F.col("name").isNull() & (share > GHOST_EMPTY_SHARE))
    return columns.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.when(keep, F.col("c")))).alias("kept"), F.count_if(~keep).alias("dropped_columns")
    )


def pick_cells(cells: Column, kept: Column) -> Column:
    return F.transform(kept, lambda i: F.get(cells, i))


def drop_ghost_columns(data: DataFrame, files: DataFrame) -> DataFrame:
    kept = kept_columns(data, files).select("file_id", "kept")
    return _with_files(data, kept).withColumn("cells", pick_cells(F.col("cells"), F.col("kept"))).drop("kept")


def is_ghost_row(cells: Column) -> Column:
    """More than 90 % empty and without any number or date: a stray note."""
    empty = 1 - filled_count(cells) / F.size(cells)
    return (F.size(cells) > 0) & (empty > GHOST_EMPTY_SHARE) & ~F.exists(present_cells(cells), value_like)


def drop_ghost_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_ghost_row(F.col("cells")))


def _name_of(text: str | None) -> str:
    import regex

    folded = regex.sub(r"\p{Extended_Pictographic}", "", fold_python(text or ""))
    name = regex.sub(r"[^a-z0-9]+", "_", folded).strip("_")[:NAME_LENGTH].rstrip("_")
    return f"{GENERATED_PREFIX}_{name}" if name[:1].isdigit() else name


def _names_of(header: list[str | None]) -> Iterator[str]:
    taken: set[str] = set()
    for i, text in enumerate(header):
        base = name = _name_of(text) or f"{GENERATED_PREFIX}_{i + 1}"
        n = 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        yield name


@F.pandas_udf(ArrayType(StringType()))
def safe_names(headers: pd.Series) -> pd.Series:
    """Unique ``[a-z0-9_]`` names of one header; applied to one row per file."""
    return headers.map(lambda h: None if h is None else list(_names_of(list(h))))


@dataclass(frozen=True)
class Tidied:
    """``rows (file_id, row_idx, cells)``, ``headers (file_id, names)`` and the report, one row per file."""

    rows: DataFrame
    headers: DataFrame
    report: DataFrame

    def table(self, *file_ids: str) -> DataFrame:
        """Files of one layout as an all-text table with named columns."""
        chosen = self.headers.filter(F.col("file_id").isin(*file_ids)) if file_ids else self.headers
        layouts = chosen.select("names").distinct().limit(2).collect()
        if len(layouts) != 1:
            raise ValueError("the files have no common layout")
        rows = self.rows.filter(F.col("file_id").isin(*file_ids)) if file_ids else self.rows
        return rows.select("file_id", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(layouts[0]["names"])])


def tidy(rows: DataFrame) -> Tidied:
    """Header found; blank rows, totals, repeated headers and ghosts removed; nothing invented or altered.

    Facts (one row per file) and the rows with their fate are written once; the kept columns, the result and the report read the
    written rows, however often they are used.
    """
    files = stored(detect_header(rows), "headers")
    fates = stored(classify_rows(rows, files), "fates")
    data = fates.filter(F.col("fate") == "data").select("file_id", "row_idx", "cells")
    kept = stored(kept_columns(data, files), "kept-columns")
    picked = _with_files(data, kept.select("file_id", "kept")).withColumn("cells", pick_cells(F.col("cells"), F.col("kept"))).drop("kept")
    out = drop_ghost_rows(picked)
    names = files.join(kept, "file_id").withColumn("raw", pick_cells(F.col("header"), F.col("kept"))).withColumn("names", safe_names("raw"))
    return Tidied(out, names.select("file_id", "names"), _report(fates, picked, names))


def _report(fates: DataFrame, picked: DataFrame, names: DataFrame) -> DataFrame:
    counts = fates.groupBy("file_id").agg(
        F.count_if(F.col("fate") == "empty").alias("empty"),
        F.count_if(F.col("fate") == "total").alias("dropped_total_rows"),
        # Labels are a few spellings of fifteen words, however many rows carry them.
        F.array_sort(F.collect_set("label")).alias("total_labels"),
        F.count_if(F.col("fate") == "repeat").alias("dropped_repeated_headers"),
    )
    ghosts = picked.groupBy("file_id").agg(F.count_if(is_ghost_row(F.col("cells"))).alias("ghosts"), F.count("*").alias("rows"))
    renamed = F.filter(
        F.zip_with("raw", "names", lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("from"), b.alias("to"))),
        lambda r: r["from"] != r["to"],
    )
    zero = F.lit(0)
    return names.join(counts, "file_id", "left").join(ghosts, "file_id", "left").select(
        "file_id",
        F.col("header_pos").alias("header_row"),
        F.greatest(F.col("header_pos") - 1, zero).alias("skipped_top_rows"),
        (F.coalesce("empty", zero) + F.coalesce("ghosts", zero)).alias("dropped_empty_rows"),
        F.col("dropped_columns").alias("dropped_empty_columns"),
        F.coalesce("dropped_total_rows", zero).alias("dropped_total_rows"),
        F.coalesce("total_labels", F.array().cast("array<string>")).alias("total_labels"),
        F.coalesce("dropped_repeated_headers", zero).alias("dropped_repeated_headers"),
        F.when(F.col("header_pos") > 0, renamed).otherwise(F.filter(renamed, lambda _: F.lit(False))).alias("renamed_columns"),
        (F.coalesce("rows", zero) - F.coalesce("ghosts", zero)).alias("row_count"),
        F.size("names").alias("column_count"),
    )
