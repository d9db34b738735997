"""Delimited text of unknown encoding and dialect, file by file within a folder.

Lines are ``(file_id, at STRUCT<block, line>, raw BINARY)``; ``at`` orders the lines of a file. Files are
read in pieces, so one file may be as large as the storage allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import clean_cell
from tallyfold.operators import tidy as T
from tallyfold.session import settled, stored

# ---- fixed values ---------------------------------------------------------------------------------------
DELIMITERS = [",", ";", "\t", "|"]
SNIFFED_LINES = 50
SAMPLE_BYTES = 4096
ZERO_MANY, ZERO_FEW = 0.3, 0.05
# ---------------------------------------------------------------------------------------------------------


def read_delimited(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """Fixed-dialect scan with every column as text; short rows are padded with nulls."""
    return spark.read.csv(paths, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", inferSchema=False)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The raw lines of every file; a line's bytes are kept as they are."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(
        F.col("_metadata.file_path").alias("file_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        F.col("value").cast("binary").alias("raw"),
    )


def _zeros(raw: Column, odd: bool) -> Column:
    """Zero bytes at odd (or even) places of a piece of bytes."""
    marked = F.regexp_replace(F.hex(raw), "..(..)?" if odd else "(..)(?:..)?", "$1,")
    return (F.length(marked) - F.length(F.replace(marked, F.lit("00,"), F.lit("")))) / 3


def detect_encoding(lines: DataFrame) -> DataFrame:
    """``(file_id, encoding)``: byte-order mark, else UTF-16 by its zero bytes, else UTF-8, else windows-1254.

    Every line is checked where it is; only the lines of a file's first 4096 bytes are brought together.
    """
    # Line numbers rise within a piece of a file, so only lines of its first piece whose number is near the first one can begin in its first bytes.
    first = F.min(F.struct("at.block", "at.line"))
    valid = F.bool_and(F.is_valid_utf8(F.col("raw").cast("string")))
    # One pass, one row per file, written: so it is seen to be small, and the lines need not be moved to meet it.
    begin = stored(lines.groupBy("file_id").agg(first.alias("begin"), valid.alias("utf8")), "file-begins")
    near = lines.join(begin, "file_id").filter((F.col("at.block") == F.col("begin.block")) & (F.col("at.line") - F.col("begin.line") < SAMPLE_BYTES))
    order = Window.partitionBy("file_id").orderBy("at")
    before = F.coalesce(F.sum(F.octet_length("raw") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = near.withColumn("n", F.row_number().over(order)).withColumn("start", before).filter(F.col("start") < SAMPLE_BYTES)
    head = head.withColumn("piece", F.substring("raw", F.lit(1), (SAMPLE_BYTES - F.col("start")).cast("int")))
    even_start = F.col("start") % 2 == 0
    odd_zeros = F.when(even_start, _zeros(F.col("piece"), True)).otherwise(_zeros(F.col("piece"), False))
    even_zeros = F.when(even_start, _zeros(F.col("piece"), False)).otherwise(_zeros(F.col("piece"), True))
    sample = head.groupBy("file_id").agg(
        F.max(F.when(F.col("n") == 1, F.hex(F.substring("raw", 1, 3)))).alias("lead"),
        (F.max(F.col("start") + F.octet_length("piece")) / 2).alias("half"),
        F.sum(odd_zeros).alias("odd"), F.sum(even_zeros).alias("even"), F.bool_and("utf8").alias("utf8"),
    )

    def mostly(many: str, few: str) -> Column:
        return (F.try_divide(many, "half") > ZERO_MANY) & (F.try_divide(few, "half") < ZERO_FEW)

    encoding = (
        F.when(F.col("lead") == "EFBBBF", "utf-8").when(F.col("lead").startswith("FFFE"), "utf-16le")
        .when(F.col("lead").startswith("FEFF"), "utf-16be").when(mostly("odd", "even"), "utf-16le")
        .when(mostly("even", "odd"), "utf-16be").when(F.col("utf8"), "utf-8").otherwise("windows-1254")
    )
    return sample.select("file_id", encoding.alias("encoding"))


def _running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the lines of the file before this one, summed per piece and carried over the pieces."""
    marked = df.withColumn("block", F.col("at.block")).withColumn("step", value.cast("bigint"))
    blocks_before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("file_id", "block").agg(F.sum("step").alias("step")).select("file_id", "block", F.coalesce(F.sum("step").over(blocks_before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("file_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("step").over(inside), F.lit(0))
    return marked.withColumn("own", own).join(carried, ["file_id", "block"]).withColumn(name, F.col("own") + F.col("carried")).drop("own", "carried", "step", "block")


def _whole_utf16_lines(lines: DataFrame) -> DataFrame:
    """UTF-16 lines put together where a character, not a line end, holds the newline byte; the line end's other half is removed.

    Whether a newline byte ends a line follows from its place in the file, odd or even, and from the byte beside it.
    """
    raw, size = F.col("raw"), F.octet_length("raw")
    placed = _running(lines, size + 1, "start")
    little = F.col("encoding") == "utf-16le"
    starts = (F.col("start") == 0) | ((F.col("start") % 2 == 1) & (F.hex(F.substring(raw, 1, 1)) == "00"))
    ends = ((F.col("start") + size) % 2 == 1) & (F.hex(F.substring(raw, -1, 1)) == "00")
    # Little endian counts the lines that started up to here, big endian the lines that ended before.
    counted = _running(placed.withColumn("starts", starts.cast("int")), F.when(little, F.col("starts")).otherwise(ends.cast("int")), "line_no")
    named = counted.withColumn("line_no", F.when(little, F.col("line_no") + F.col("starts")).otherwise(F.col("line_no")))
    whole = named.groupBy("file_id", "encoding", "line_no").agg(
        F.min("at").alias("at"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda r: F.hex(r["raw"])), "0A")).alias("raw"))
    odd = size % 2 == 1
    cut = F.when(~odd, raw).when(little, F.substring(raw, F.lit(2), size)).otherwise(F.substring(raw, F.lit(1), size - 1))
    return whole.select("file_id", "at", "encoding", cut.alias("raw"))


def decode_lines(lines: DataFrame, encodings: DataFrame) -> DataFrame:
    """``(file_id, at, text)`` of every line."""
    raw, known = F.col("raw"), lines.join(encodings, "file_id").select("file_id", "at", "encoding", "raw")
    wide = F.col("encoding").startswith("utf-16")
    rows = known.filter(~wide)
    if not encodings.filter(wide).isEmpty():
        rows = rows.unionByName(_whole_utf16_lines(known.filter(wide)))
    text = (
        F.when(F.col("encoding") == "utf-16le", F.decode(raw, "UTF-16LE")).when(F.col("encoding") == "utf-16be", F.decode(raw, "UTF-16BE"))
        .when(F.col("encoding") == "windows-1254", F.decode(raw, "windows-1254")).otherwise(raw.cast("string"))
    )
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\\z", "")
    return rows.select("file_id", "at", plain.alias("text"))


def _count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _quoting(text: Column, d: str) -> tuple[Column, Column]:
    """Whether a quote is open after the line, if none was open before it and if one was.

    A quote opens only at the start of a field; within it two quotes are one character, and a single one closes it.
    """
    mark = "\\" + d if d == "|" else d
    inside, rest = r'(?:[^"]|"")*+', rf"[^{mark}]*+"
    fields = rf'(?:(?:"{inside}"{rest}|[^"{mark}]{rest}|){mark})*+'
    opens = rf'{fields}"{inside}\z'
    return text.rlike("^" + opens), text.rlike(rf'^{inside}(?:\z|"{rest}{mark}{opens})')


def _open_before(rows: DataFrame, keys: list[str], carried: Column | None = None) -> DataFrame:
    """``opened``: whether a quote is open before the line; rows have at, after_closed, after_open.

    A line either leaves the state as it is, sets it, or turns it: the state is that of the last line that set it, turned as often as
    lines have turned it since.
    """
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("after_closed") == F.col("after_open")
    turned = F.coalesce(F.sum(F.when(F.col("after_closed") & ~F.col("after_open"), 1).otherwise(0)).over(before), F.lit(0))
    counted = rows.withColumn("turned", turned)
    last = F.max(F.when(sets, F.struct("at", F.col("after_closed").cast("int").alias("state"), "turned"))).over(before)
    state = F.coalesce(F.col("last.state"), carried.cast("int") if carried is not None else F.lit(0)) + F.col("turned") - F.coalesce(F.col("last.turned"), F.lit(0))
    return counted.withColumn("last", last).withColumn("opened", state % 2 == 1).drop("last", "turned")


def sniff_delimiter(texts: DataFrame) -> DataFrame:
    """``(file_id, delimiter)``: the mark under which most of the first lines agree on their field count."""
    order = Window.partitionBy("file_id").orderBy("at")
    head = texts.filter(F.trim("text") != "").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SNIFFED_LINES)
    # Lines of one record are put together under each mark; at most fifty lines of a file meet here.
    each = head.select("file_id", "at", "text", F.inline(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(d).alias("delimiter"), a.alias("after_closed"), b.alias("after_open"))
        for i, d in enumerate(DELIMITERS) for a, b in [_quoting(F.col("text"), d)]])))
    upto = Window.partitionBy("file_id", "place").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = _open_before(each, ["file_id", "place"]).withColumn("record", F.sum(F.when(F.col("opened"), 0).otherwise(1)).over(upto))
    records = numbered.groupBy("file_id", "place", "delimiter", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda r: r["text"]), "\n").alias("text")
    )
    count = F.lit(None).cast("int")
    for d in DELIMITERS:
        mark = "\\" + d if d == "|" else d
        outside = F.regexp_replace("text", rf'(^|{mark})"(?:[^"]|"")*+"', "$1")
        count = F.when(F.col("delimiter") == d, _count_of(outside, d) + 1).otherwise(count)
    fields = records.select("file_id", "place", "delimiter", count.alias("fields"))
    tally = fields.groupBy("file_id", "place", "delimiter", "fields").agg(F.count("*").alias("agreeing"))
    modal = tally.groupBy("file_id", "place", "delimiter").agg(F.max(F.struct("agreeing", "fields")).alias("best"))
    usable = modal.filter(F.col("best.fields") >= 2).groupBy("file_id").agg(
        F.max_by("delimiter", F.struct(F.col("best"), -F.col("place"))).alias("delimiter")
    )
    files = head.select("file_id").distinct()
    return files.join(usable, "file_id", "left").select("file_id", F.coalesce("delimiter", F.lit(DELIMITERS[0])).alias("delimiter"))


def join_quoted_lines(texts: DataFrame, delimiters: DataFrame) -> DataFrame:
    """Records: lines belong together while a quoted field is open.

    Only files with a line that leaves a quote open need it. What a line does to the state is composed per piece of a file
    and carried over the pieces, so that no file is walked by a single task.
    """
    known = texts.join(delimiters, "file_id", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(DELIMITERS[0])))
    after_closed, after_open = F.lit(False), F.lit(True)
    for d in DELIMITERS:
        closed, opened = _quoting(F.col("text"), d)
        this = (F.col("delimiter") == d) & F.contains("text", F.lit('"'))
        after_closed, after_open = F.when(this, closed).otherwise(after_closed), F.when(this, opened).otherwise(after_open)
    # What a line does to the state is read several times below; the patterns run once.
    lines = stored(known.select("file_id", "at", "text", after_closed.alias("after_closed"), after_open.alias("after_open"), F.col("at.block").alias("block")), "quoting")
    open_files = stored(lines.filter("after_closed").select("file_id").distinct(), "open-files")
    if open_files.isEmpty():
        return texts
    simple = lines.join(open_files, "file_id", "left_anti")
    broken = lines.join(open_files, "file_id", "left_semi")
    # What a whole piece does to the state, and its last start of a record: met with the quote closed and open before the piece, in one pass.
    # A line starts a record when no quote is open before it; a record is named by its first line.
    both = broken
    for name, before in (("after_closed", False), ("after_open", True)):
        both = _open_before(both, ["file_id", "block"], F.lit(before)).withColumnRenamed("opened", f"opened_{name}")
    facts = []
    for name in ("after_closed", "after_open"):
        opened = F.col(f"opened_{name}")
        facts.append(F.max(F.struct("at", F.when(opened, F.col("after_open")).otherwise(F.col("after_closed")).alias("after"))).getField("after").alias(name))
        facts.append(F.max(F.when(~opened, F.col("at"))).alias(f"latest_{name}"))
    pieces = settled(both.groupBy("file_id", "block").agg(*facts).withColumn("at", F.col("block")))
    latest = F.when(F.col("opened"), F.col("latest_after_open")).otherwise(F.col("latest_after_closed"))
    blocks_before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(_open_before(pieces, ["file_id"]).select("file_id", "block", F.col("opened").alias("carried"), F.max(latest).over(blocks_before).alias("earlier")), "quoting-pieces")
    started = _open_before(broken.join(carried, ["file_id", "block"]), ["file_id", "block"], F.col("carried")).withColumn("start", F.when(~F.col("opened"), F.col("at")))
    upto = Window.partitionBy("file_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = started.withColumn("record", F.coalesce(F.max("start").over(upto), F.col("earlier")))
    whole = named.groupBy("file_id", F.col("record").alias("at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda r: r["text"]), "\n").alias("text")
    )
    return simple.select("file_id", "at", "text").unionByName(whole)


def _fields(text: Column, d: str) -> Column:
    mark = "\\" + d if d == "|" else d
    plain = F.split(text, mark, -1)
    pieces = F.regexp_extract_all(
        F.concat(F.lit(d), text), F.lit(rf'{mark}("(?:[^"]|"")*+"(?={mark}|\z)|[^{mark}]*)'), F.lit(1)
    )
    bare = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r'(?s)^".*"\z'), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(p),
    )
    return F.when(text.contains('"'), bare).otherwise(plain)


def split_fields(texts: DataFrame, delimiters: DataFrame) -> DataFrame:
    """``(file_id, row_idx, cells)``: each record cut by its file's delimiter, cells cleaned."""
    text, d = F.col("text"), F.col("delimiter")
    cells = F.when(d == DELIMITERS[0], _fields(text, DELIMITERS[0]))
    for mark in DELIMITERS[1:]:
        cells = cells.when(d == mark, _fields(text, mark))
    known = texts.join(delimiters, "file_id", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(DELIMITERS[0])))
    return known.select("file_id", F.col("at").alias("row_idx"), F.transform(cells, clean_cell).alias("cells"))


def ingest(lines: DataFrame) -> T.Tidied:
    """Raw lines to tidy rows: encoding, dialect, records, fields, then the tidying."""
    encodings = stored(detect_encoding(lines), "encodings")
    # Decoding puts UTF-16 lines together over several shuffles, and three steps read what comes of it.
    texts = stored(decode_lines(lines, encodings), "texts")
    delimiters = stored(sniff_delimiter(texts), "delimiters")
    # The tidying reads the cells several times: they are written once, the small facts too.
    done = T.tidy(stored(split_fields(join_quoted_lines(texts, delimiters), delimiters), "cells"))
    report = done.report.join(encodings, "file_id").join(delimiters, "file_id", "left")
    return T.Tidied(done.rows, done.headers, report)
