"""Cells of workbooks as tables: ``(book, sheet, row, col, value)`` and what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------------
EPOCH_1900, EPOCH_1904_SHIFT = "1899-12-30", 1462
TIME_ONLY = r"(?i)^[\[\]hms:.\s0ap/\"]+\z"
HALF_DAY_MARK = r"(?i)am/pm|a/p"
LAST_SERIAL = 2958465
# -----------------------------------------------------------------------------------------------------


def plain_number(c: Column) -> Column:
    """Number text written out in digits; text without an exponent stays as it is."""
    number = F.when(
        F.abs(c.try_cast("double")) < 1e17, c.try_cast("decimal(38,20)").cast("string")
    ).otherwise(c.try_cast("decimal(38,0)").cast("string"))
    short = F.when(number.contains("."), F.regexp_replace(number, r"\.?0+\z", "")).otherwise(number)
    return F.when(c.rlike(r"[eE]"), F.coalesce(short, c)).otherwise(c)


def serial_to_date(serial: Column, date1904: Column, number_format: Column) -> Column:
    """A day number as ``yyyy-MM-dd[ HH:mm:ss]``; a time-only format gives ``HH:mm:ss``.

    Day 60 of the 1900 system is the 29 February that never was; it is written as such.
    """
    days = F.floor(serial)
    seconds = (serial - days) * 86400
    whole = F.floor(seconds)
    second = F.when(seconds - whole > 0.9999, whole + 1).otherwise(whole)
    day = days + F.when(second == 86400, 1).otherwise(0) + F.when(date1904, EPOCH_1904_SHIFT).otherwise(0)
    clock = F.date_format(F.timestamp_seconds(second % 86400), "HH:mm:ss")
    shifted = F.date_add(F.to_date(F.lit(EPOCH_1900)), (day + F.when(day < 60, 1).otherwise(0)).cast("int"))
    text = F.when(day == 60, F.lit("1900-02-29")).when(day == 0, F.lit("1900-01-00")).otherwise(F.date_format(shifted, "yyyy-MM-dd"))
    stamped = F.when(second % 86400 > 0, F.concat(text, F.lit(" "), clock)).otherwise(text)
    timed = F.regexp_replace(number_format, HALF_DAY_MARK, "").rlike(TIME_ONLY)
    return F.when((serial >= 0) & (serial <= LAST_SERIAL), F.when(timed, clock).otherwise(stamped))


def date_to_serial(text: Column) -> Column:
    """``yyyy-MM[-dd[ HH:mm[:ss]]]`` as a day number of the 1900 system; other text gives null."""
    shape = r"^(\d{4})-(\d{2})(?:-(\d{2}))?(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?)?"
    moment = F.when(text.rlike(shape), F.replace(F.regexp_extract(text, shape, 0), F.lit("T"), F.lit(" "))).try_cast("timestamp_ntz")
    seconds = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    return F.datediff(moment.cast("date"), F.lit(EPOCH_1900)) + seconds / 86400.0


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells with empty places of merged ranges taking the range's top-left value; ``filled`` marks them.

    ``ranges (book, sheet, r0, c0, r1, c1)``. Every place of a range becomes a cell of the result
    anyway, so ranges are spread to places and meet the cells on equal keys; no range join is needed.
    """
    at = ["book", "sheet", "row", "col"]
    corner = cells.filter(F.col("value").isNotNull()).select("book", "sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("given"))
    valued = ranges.join(corner, ["book", "sheet", "r0", "c0"])
    places = valued.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    both = cells.join(places.select(*at, "given"), at, "full")
    return both.select(*at, F.coalesce("value", "given").alias("value"), (F.col("value").isNull() & F.col("given").isNotNull()).alias("filled"))


def sheet_inventory(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """``(book, sheet, rows, columns)`` of sheets with data; hidden ones only where no visible one has any."""
    used = cells.filter(F.col("value").isNotNull()).groupBy("book", "sheet", "row").agg(F.max("col").alias("last"))
    sizes = used.groupBy("book", "sheet").agg(F.count("*").alias("rows"), (F.max("last") + 1).alias("columns"))
    listed = sizes.join(sheets.select("book", "sheet", "hidden"), ["book", "sheet"])
    seen = listed.groupBy("book").agg(F.bool_or(~F.col("hidden")).alias("any_visible"))
    return listed.join(seen, "book").filter(~F.col("hidden") | ~F.col("any_visible")).select("book", "sheet", "rows", "columns")


def hidden_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """How many rows with a value are hidden, per sheet. They are only counted, not removed."""
    used = cells.filter(F.col("value").isNotNull()).select("book", "sheet", "row").distinct()
    hidden = rows.filter(F.col("hidden")).join(used, ["book", "sheet", "row"], "left_semi")
    return hidden.groupBy("book", "sheet").agg(F.count("*").alias("hidden_rows"))


def to_sheet_rows(cells: DataFrame) -> DataFrame:
    """``(file_id, row_idx, cells)`` for the tidying; a row is as wide as its last cell."""
    by_row = cells.groupBy("book", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("last"))
    wide = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda c: F.try_element_at("m", c))
    return by_row.select(F.concat_ws("/", "book", "sheet").alias("file_id"), F.col("row").alias("row_idx"), wide.alias("cells"))
