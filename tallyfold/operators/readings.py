"""Cross-check of recognised figures: a value counts only when two readings agree.

Readings are ``(doc_id, row, col, engine, text, conf)``; engine 1 read the table, engine 2 the page again, higher
numbers re-read single cells. Where a document may hold several tables, ``table_no`` tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import TURKISH_FROM, TURKISH_TO, tr_lower
from tallyfold.operators.pages import LOW_CONFIDENCE
from tallyfold.session import Scratch

# ---- fixed values -------------------------------------------------------------------------------------
NUMBER = r"(?i)^[-+(]?[₺$€£]?\d[\d.,]*%?(₺|tl|try|usd|eur|\$|€)?\)?-?\z"
DATE = r"^\d{1,4}[./-]\d{1,2}[./-]\d{1,4}(\d{1,2}:\d{2}(:\d{2})?)?\z"
LIKE_DIGITS = r"^[(−-]?[\d.,:/-]*[OoDIl|iSsBZzg][\dOoDIl|iSsBZzg.,:/-]*[)%]?\z"
CONFUSED_FROM, CONFUSED_TO = "OoDIl|iSsBZzg", "0001111558229"
NEGATIVE = r"^\s*[-−(]|-\s*\z"
LETTERS_ONLY = r"^[\p{L}.,:;'’()-]+\z"
UNCERTAIN_MARK = "(?)"
VALUE_SHARE, SHORT_TOKEN, SAME_PLACE, BOX_PAD = 0.6, 4, 0.6, 1
BAND = 40
# -------------------------------------------------------------------------------------------------------


def _table_of(df: DataFrame) -> list[str]:
    return ["doc_id", "table_no"] if "table_no" in df.columns else ["doc_id"]


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def digitize(c: Column) -> Column:
    """A token of digits and letters mistaken for digits, read as digits."""
    t = compact(c)
    return F.when(t.rlike(LIKE_DIGITS), F.translate(t, CONFUSED_FROM, CONFUSED_TO)).otherwise(t)


def is_value(c: Column) -> Column:
    t = compact(c)
    return t.rlike(NUMBER) | t.rlike(DATE)


def value_columns(first: DataFrame) -> DataFrame:
    """Columns whose filled cells below the first are mostly values."""
    marked = first.filter(F.col("text").isNotNull()).withColumn("v", is_value(digitize(F.col("text"))).cast("int"))
    table = _table_of(first)
    columns = marked.groupBy(*table, "col").agg(F.count("*").alias("n"), F.sum("v").alias("values"), F.min_by("v", "row").alias("top"))
    body = F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.col("n"))
    values = F.when(F.col("n") > 1, F.col("values") - F.col("top")).otherwise(F.col("values"))
    return columns.filter(values >= VALUE_SHARE * body).select(*table, "col")


def _with_marks(agreed: Column, marked: Column) -> Column:
    """The agreed digits with the sign and percent of the first two readings; null when their signs differ."""
    valued = F.filter(marked, lambda t: t.isNotNull() & is_value(digitize(t)))
    minus = F.filter(valued, lambda t: t.rlike(NEGATIVE))
    split = (F.size(minus) > 0) & (F.size(minus) < F.size(valued))
    digits = F.regexp_replace(compact(agreed), r"^[-−(]+|[)\-%]+\z", "")
    sign = F.when((F.size(minus) > 0) | agreed.rlike(NEGATIVE), "-").otherwise("")
    percent = F.when(F.exists(valued, lambda t: t.contains("%")) | agreed.contains("%"), "%").otherwise("")
    return F.when(~split, F.concat(sign, digits, percent))


def reading_vote(readings: DataFrame) -> DataFrame:
    """``(doc_id, row, col, text, checked, corrected, uncertain)`` for every cell of the first engine."""
    table = _table_of(readings)
    cell = [*table, "row", "col"]
    first = readings.filter(F.col("engine") == 1)
    columns = value_columns(first).withColumn("in_value_column", F.lit(True))
    # A cell has a few readings: they are brought together once, unmerged before, and every engine's text is taken from the list.
    tables = Scratch(readings.sparkSession)
    listed = readings.repartition(*cell).groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("engine", "text"))).alias("read"))

    def text_by(engine: int) -> Column:
        return F.array_max(F.transform(F.filter("read", lambda r: r["engine"] == engine), lambda r: r["text"]))

    # Written before they are moved to their columns, so that the shuffles of the two steps do not lie on the disk together.
    cells = tables.stored(listed.filter(F.exists("read", lambda r: r["engine"] == 1)).select(
        *cell, text_by(1).alias("first"), text_by(2).alias("second"), F.transform("read", lambda r: r["text"]).alias("all")
    ), "listed").join(columns, [*table, "col"], "left").withColumn("in_value_column", F.coalesce("in_value_column", F.lit(False)))
    # Cells without a place in a value column need no patterns; the others meet each pattern once, as they are read by two steps and several columns.
    known = tables.stored(cells.withColumn("like_value", F.when(F.col("in_value_column"), is_value(digitize(F.col("first"))))), "cells")
    tables.drop("listed")
    value_rows = known.filter("like_value").select(*table, "row").distinct().withColumn("value_row", F.lit(True))
    known = known.join(value_rows, [*table, "row"], "left")
    text, second = F.col("first"), F.col("second")
    misread = (F.length(compact(text)) <= SHORT_TOKEN) | text.rlike(r"\d")
    placed = F.col("in_value_column") & F.coalesce("value_row", F.lit(False)) & text.isNotNull()
    known = known.withColumn("plain_value", F.when(placed, is_value(text)))
    checked = F.when(F.col("plain_value"), True).when(placed, misread)
    same = F.when(F.col("plain_value") & second.isNotNull(), digitize(second) == compact(text))
    known = known.withColumn("checked", F.coalesce(checked, F.lit(False))).withColumn("open", F.col("checked") & ~F.coalesce(same, F.lit(False)))
    # Votes stand in a column of their own: inside the comparison they would be read again for every vote.
    known = known.withColumn("votes", F.when(F.col("open"), F.filter(F.transform(F.filter("all", lambda t: t.isNotNull()), digitize), is_value)))
    votes = F.col("votes")
    agreed = F.get(F.filter(votes, lambda t: F.size(F.filter(votes, lambda u: u == t)) >= 2), F.lit(0))
    known = known.withColumn("agreed", F.when(F.col("open"), agreed))
    known = known.withColumn("value", F.when(F.col("agreed").isNotNull(), _with_marks(F.col("agreed"), F.array(text, second))))
    changed = compact(F.col("value")) != compact(text)
    result = (
        F.when(~F.col("open"), text).when(F.col("value").isNull(), F.concat(text, F.lit(f" {UNCERTAIN_MARK}")))
        .when(changed, F.col("value")).otherwise(text)
    )
    return known.select(
        *cell, result.alias("text"), "checked", (F.col("open") & F.coalesce(changed, F.lit(False))).alias("corrected"),
        (F.col("open") & F.col("value").isNull()).alias("uncertain"),
    )


def _bands(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Boxes spread over the page bands they touch, so that only neighbours are compared."""
    return df.withColumn("band", F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND))))


def second_readings(boxes: DataFrame, words: DataFrame, engine: int | None = 2) -> DataFrame:
    """A further engine's text of each cell: the words whose centre lies in the cell's box. Without ``engine`` the words name theirs, and all meet the boxes at once."""
    cell = [*_table_of(boxes), "row", "col"]
    words = words if engine is None else words.withColumn("engine", F.lit(engine))
    cells = _bands(boxes, F.col("y0") - BOX_PAD, F.col("y1") + BOX_PAD)
    centre_y = F.col("y") - F.col("h") / 2
    placed = words.select("doc_id", "page", "engine", F.col("text").alias("word"), F.col("x0").alias("wx"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), centre_y.alias("cy"))
    placed = placed.withColumn("band", F.floor(F.col("cy") / BAND))
    inside = F.col("cx").between(F.col("x0") - BOX_PAD, F.col("x1") + BOX_PAD) & F.col("cy").between(F.col("y0") - BOX_PAD, F.col("y1") + BOX_PAD)
    met = cells.join(placed, ["doc_id", "page", "band"]).filter(inside)
    return met.groupBy(*cell, "engine").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wx", "word"))), lambda w: w["word"]), " ").alias("text")
    ).select(*cell, "engine", "text")


def restore_letters(words: DataFrame, letters: DataFrame) -> DataFrame:
    """Letters of a word taken from a second reading of the same place, only if equal once folded.

    Both sides are ``(doc_id, page, seq, text, x0, y0, x1, y1)``; figures never change.
    """
    def plain(c: Column) -> Column:
        return F.translate(tr_lower(c), TURKISH_FROM, TURKISH_TO)

    main = _bands(words.filter(F.col("text").rlike(LETTERS_ONLY)), F.col("y0"), F.col("y1"))
    other = _bands(letters.filter(F.col("text").rlike(LETTERS_ONLY)), F.col("y0"), F.col("y1"))
    other = other.select("doc_id", "page", "band", *[F.col(c).alias(f"o_{c}") for c in ("seq", "text", "x0", "y0", "x1", "y1")])
    w = F.least("x1", "o_x1") - F.greatest("x0", "o_x0")
    h = F.least("y1", "o_y1") - F.greatest("y0", "o_y0")
    area = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("o_x1") - F.col("o_x0")) * (F.col("o_y1") - F.col("o_y0")))
    met = main.join(other, ["doc_id", "page", "band"]).filter((w > 0) & (h > 0) & (w * h / area >= SAME_PLACE))
    twins = met.groupBy("doc_id", "page", "seq").agg(F.min_by("o_text", "o_seq").alias("twin"))
    known = words.join(twins, ["doc_id", "page", "seq"], "left")
    better = F.col("twin").isNotNull() & (F.col("twin") != F.col("text")) & (plain(F.col("twin")) == plain(F.col("text")))
    restored = F.coalesce(better, F.lit(False))
    return known.withColumn("restored", restored).withColumn("text", F.when(restored, F.col("twin")).otherwise(F.col("text"))).drop("twin")


def reading_report(words: DataFrame, votes: DataFrame) -> DataFrame:
    """Per document: words read with low confidence, and cells checked, corrected and left uncertain."""
    low = words.groupBy("doc_id").agg(F.count_if(F.col("conf") < LOW_CONFIDENCE).alias("low_confidence_words"))
    cells = votes.groupBy("doc_id").agg(*[F.count_if(c).alias(f"{c}_cells") for c in ("checked", "corrected", "uncertain")])
    return low.join(cells, "doc_id", "full").na.fill(0)
