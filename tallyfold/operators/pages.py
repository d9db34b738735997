"""Tables rebuilt from positioned page text, for any number of documents at once.

Glyphs are ``(doc_id, page, text, x0, x1, y, h, conf)`` in points, y growing downwards; pages are
``(doc_id, page, width, height)`` and rules ``(doc_id, page, x0, y0, x1, y1)``. Work is grouped by page or by
one table's part of a page; across pages only one row per page meets, in spans of pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import tr_lower
from tallyfold.session import Scratch, settled

# ---- fixed values: shapes and distances ---------------------------------------------------------------
NUMERIC = r"(?i)^[-+(]?[₺$€£]?\s*\d[\d.,\s]*%?\s*(₺|tl|try|usd|eur|\$|€)?\)?-?\z"
DATE = r"^\d{1,4}[./-]\d{1,2}[./-]\d{1,4}(\s+\d{1,2}:\d{2}(:\d{2})?)?\z"
RULE_MARKS, RULE_TEXT = "|_¦", r"^[|_¦]+\z"
PAGE_NUMBER = r"^(sayfa|page|s\.|p\.)?\s*#\s*((\/|of|\/ ?|-)\s*#)?\z|^#\s*(\/|of)\s*#\z|^-\s*#\s*-\z"
WORD_GAP, GLUE_GAP = 0.6, 0.1
MIN_COLUMN_GAP = 2.5
FURNITURE_ZONE, NEAR_LINES = 0.12, 3
PROSE_WIDTH = 0.45
REGION_GAP, TITLE_GAP, DEFAULT_PITCH = 3.5, 1.8, 12.0
SAME_EXTENT = 0.85
RULE_WIDTH, RULE_COVER, RULE_APART = 1.5, 0.5, 2.0
HEADER_WIDTH, COVER_ALLOWED = 0.7, 0.08
WRAP_GAP = 1.5
BELOW_BASE = 0.3
OCR_CHARS, LOW_CONFIDENCE = 10, 70
# -------------------------------------------------------------------------------------------------------

SPAN_PAGES = 512

PAGE = ["doc_id", "page"]
TABLE = ["doc_id", "table_no"]


def is_value(c: Column) -> Column:
    return c.rlike(NUMERIC) | c.rlike(DATE)


def split_spaced(glyphs: DataFrame) -> DataFrame:
    """Text items that align columns with runs of spaces become one item per column, placed by character share."""
    # Most texts hold single blanks at most and meet no pattern.
    wide = F.lit(False)
    for mark in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
        wide = wide | F.col("text").contains(mark)
    text = F.rtrim(F.when(wide, F.regexp_replace("text", r"\s+\z", "")).otherwise(F.col("text")))
    pieces = F.col("_pieces")
    share = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))

    def placed(p: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, q: a + F.length(q))
        word = F.regexp_replace(p, r"^\s+", "")
        start = before + F.length(p) - F.length(word)
        return F.struct(word.alias("text"), (F.col("x0") + start * share).alias("x0"), (F.col("x0") + (start + F.length(word)) * share).alias("x1"))

    whole = F.array(F.struct(F.trim(text).alias("text"), "x0", "x1"))
    parts = F.when(pieces.isNotNull(), F.transform(pieces, placed)).otherwise(whole)
    others = [c for c in glyphs.columns if c not in ("text", "x0", "x1")]
    spaced = F.when(wide & text.rlike(r"\S\s{2,}\S"), F.regexp_extract_all(text, F.lit(r"\s*\S+(?: \S+)*"), F.lit(0)))
    out = glyphs.withColumn("_pieces", spaced).select(*others, F.inline(parts))
    return out.filter((F.col("text") != "") & (F.col("h") > 0) & ~(F.substring("text", 1, 1).isin(*RULE_MARKS) & F.col("text").rlike(RULE_TEXT)))


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first is another one than the one before it; nulls are alike."""
    values = column.combine_chunks()
    now, before = values[1:], values[:-1]
    return pc.fill_null(pc.not_equal(now, before), pc.not_equal(now.is_null(), before.is_null()) if values.null_count else False).to_numpy(zero_copy_only=False)


def _in_line_order(rows: pa.Table, starts: list[int]) -> pa.Table:
    """The glyphs of each line by x0, y, x1, text, h and conf. Lines of one height come in that order; the others are sorted."""
    x0, y, x1 = (rows.column(c).to_numpy() for c in ("x0", "y", "x1"))
    inside = np.ones(len(x0) - 1, bool)
    inside[np.array(starts[1:], int) - 1] = False
    rising = (x0[1:] > x0[:-1]) | (x0[1:] == x0[:-1]) & ((y[1:] > y[:-1]) | (y[1:] == y[:-1]) & (x1[1:] > x1[:-1]))
    if (rising | ~inside).all():
        return rows
    line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x0))))
    keys = ["_line", "x0", "y", "x1", "text", "h", "conf"]
    return rows.take(pc.sort_indices(rows.append_column("_line", pa.array(line)), [(k, "ascending") for k in keys]))


def _middles(values: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The median of each line's values."""
    out = values[at]
    for i in np.flatnonzero(np.minimum.reduceat(values, at) != np.maximum.reduceat(values, at)).tolist():
        ordered, n = np.sort(values[at[i]:at[i] + sizes[i]]), sizes[i]
        out[i] = 0.5 * ordered[(n - 1) // 2] + 0.5 * ordered[n // 2]
    return out


def _reach(x1: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far to the right each line reaches up to each of its glyphs."""
    falls = np.flatnonzero(x1[1:] < x1[:-1]) + 1
    lines = np.unique(np.searchsorted(at, falls, side="right") - 1)
    if not len(lines):
        return x1
    out = x1.copy()
    for i in lines[sizes[lines] > 1].tolist():
        out[at[i]:at[i] + sizes[i]] = np.maximum.accumulate(x1[at[i]:at[i] + sizes[i]])
    return out


def page_lines(glyphs: DataFrame) -> DataFrame:
    """``(doc_id, page, line, y, h, segments, x0, x1)``: visual lines, each cut into segments at wide gaps.

    A glyph belongs to the open line while its baseline is close to the line's first glyph. Pages pass through a task as a stream sorted by height: what is
    held is one line, however many glyphs the page has. Glyphs without a place take no part.
    """
    items = split_spaced(glyphs).where(F.col("y").isNotNull() & F.col("x0").isNotNull() & F.col("x1").isNotNull())
    kinds = dict(items.dtypes)
    placed = items.select(*PAGE, *[F.col(c).cast("double") for c in ("y", "x0", "x1", "h")], "text", F.coalesce(F.col("conf").cast("double"), F.lit(100.0)).alias("conf"))
    segment = pa.struct([("text", pa.string()), ("x0", pa.float64()), ("x1", pa.float64()), ("conf", pa.float64())])

    names = [*PAGE, "line", "y", "h", "segments", "x0", "x1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, line = None, 0  # the open line's glyphs and its number on the page

        def made(rows: pa.Table, starts: list[int], numbers: list[int]) -> pa.RecordBatch:
            """Whole lines of glyphs as rows; ``starts`` are their first glyphs."""
            rows = _in_line_order(rows, starts)
            y, x0, x1, h, conf = (rows.column(c).to_numpy() for c in ("y", "x0", "x1", "h", "conf"))
            at, n = np.array(starts), len(y)
            sizes = np.diff(np.append(at, n))
            mid_y, mid_h = _middles(y, at, sizes), _middles(h, at, sizes)
            first = np.zeros(n, bool)
            first[at] = True
            gap = np.concatenate(([0.0], x0[1:] - _reach(x1, at, sizes)[:-1]))
            pitch = np.repeat(mid_h, sizes)
            cut = first | (gap > WORD_GAP * pitch)
            texts, cuts = rows.column("text").combine_chunks(), np.flatnonzero(cut)
            if len(cuts) < n:
                parts = pc.if_else(pa.array(~cut & (gap > GLUE_GAP * pitch)), pc.binary_join_element_wise("", texts, " "), texts)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cuts, n).astype(np.int32)), parts), "")
            parts = [texts, pa.array(x0[cuts]), pa.array(np.maximum.reduceat(x1, cuts)), pa.array(np.minimum.reduceat(conf, cuts))]
            upto = np.append(np.searchsorted(cuts, at), len(cuts)).astype(np.int32)
            segments = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays(parts, fields=list(segment)))
            keys = [rows.column(c).combine_chunks().take(pa.array(at)) for c in PAGE]
            columns = [*keys, pa.array(numbers, pa.int32()), pa.array(mid_y), pa.array(mid_h), segments, pa.array(x0[at]), pa.array(np.maximum.reduceat(x1, at))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            y, h = rows.column("y").to_numpy(), rows.column("h").to_numpy()
            other_page = _differs(rows.column("doc_id")) | _differs(rows.column("page"))
            # A glyph as high and as large as the one before it on its page stays on that one's line.
            changes = np.flatnonzero(other_page | (y[1:] != y[:-1]) | (h[1:] != h[:-1])) + 1
            starts, numbers, first_y, first_h = [0], [line if held is not None else 0], float(y[0]), float(h[0])
            for i, fresh, at, high in zip(changes.tolist(), other_page[changes - 1].tolist(), y[changes].tolist(), h[changes].tolist()):
                if fresh or (at != first_y and abs(at - first_y) > 0.5 * min(high, first_h)):
                    starts.append(i)
                    numbers.append(0 if fresh else numbers[-1] + 1)
                    first_y, first_h = at, high
            held, line = rows.slice(starts[-1]), numbers[-1]
            if len(starts) > 1:
                yield made(rows.slice(0, starts[-1]), starts[:-1], numbers[:-1])
        if held is not None:
            yield made(held, [0], [line])

    ordered = placed.repartition(*PAGE).sortWithinPartitions(*PAGE, "y", "x0", "x1", "h", "text", "conf")
    return ordered.mapInArrow(run, (
        f"doc_id {kinds['doc_id']}, page {kinds['page']}, line int, y double, h double, "
        "segments array<struct<text: string, x0: double, x1: double, conf: double>>, x0 double, x1 double"))


def _furniture_key(lines: DataFrame) -> Column:
    text = F.regexp_replace(tr_lower(F.array_join(F.transform("segments", lambda s: s["text"]), " ")), r"\s+", " ")
    row_like = (F.size("segments") >= 2) & F.exists("segments", lambda s: is_value(s["text"]))
    return F.when(row_like, F.concat(F.lit("="), text)).otherwise(F.regexp_replace(text, r"\d+", "#"))


def drop_page_furniture(lines: DataFrame, pages: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """Lines with ``furniture`` set where they are page headers, footers or page numbers."""
    order = Window.partitionBy(*PAGE).orderBy("line")
    n = F.size("segments")
    placed = lines.join(pages.select(*PAGE, "width", "height"), PAGE)

    def near(shift) -> Column:
        other_y, other_h, other_n = (shift(c).over(order) for c in (F.col("y"), F.col("h"), n))
        return F.coalesce((other_n >= 2) & (F.abs(other_y - F.col("y")) <= NEAR_LINES * F.greatest(F.col("h"), other_h)), F.lit(False))

    row = (n >= 2) & (near(F.lead) | near(F.lag))
    zone = (F.col("y") < F.col("height") * FURNITURE_ZONE) | (F.col("y") > F.col("height") * (1 - FURNITURE_ZONE))
    # Lines are written once, with what tells furniture; only those that may be furniture are read to judge it.
    keyed = (tables or Scratch(lines.sparkSession)).stored(
        placed.withColumn("candidate", zone & ~row).withColumn("key", F.when(F.col("candidate"), _furniture_key(lines))).select(*lines.columns, "width", "candidate", "key"),
        "lines")
    candidates = keyed.filter("candidate").select(*PAGE, "line", "key")
    counts = candidates.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("seen"))
    totals = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    # A document's keys are judged before they meet its lines, which are moved once for it.
    often = (F.col("pages") >= 2) & (F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2)))
    repeated = counts.join(totals, "doc_id").filter(often).select("doc_id", "key", F.lit(True).alias("repeated"))
    judged = candidates.join(repeated, ["doc_id", "key"], "left").filter(F.coalesce("repeated", F.lit(False)) | F.col("key").rlike(PAGE_NUMBER))
    known = keyed.join(judged.select(*PAGE, "line", F.lit(True).alias("furniture")), [*PAGE, "line"], "left")
    return known.select(*lines.columns, "width", F.coalesce("furniture", F.lit(False)).alias("furniture"))


def page_regions(lines: DataFrame) -> DataFrame:
    """Lines of table regions with their ``region`` on the page; prose and lone lines are left out."""
    order = Window.partitionBy(*PAGE).orderBy("line")
    kept = lines.filter(~F.col("furniture")) if "furniture" in lines.columns else lines
    n = F.size("segments")
    prose = (n == 1) & (F.col("x1") - F.col("x0") > PROSE_WIDTH * F.col("width")) & ~is_value(F.get("segments", F.lit(0))["text"])
    kept = kept.withColumn("prose", prose).withColumn("gap", F.col("y") - F.lag("y").over(order))
    usual = F.median("gap").over(Window.partitionBy(*PAGE))
    known = kept.withColumn("pitch", F.coalesce(F.nullif(usual, F.lit(0.0)), F.lit(DEFAULT_PITCH)))
    wide = F.col("gap") > REGION_GAP * F.greatest(F.col("h"), F.lag("h").over(order))
    titled = (F.col("gap") > TITLE_GAP * F.col("pitch")) & (n == 1)
    starts = F.coalesce(F.lag("prose").over(order), F.lit(True)) | wide | titled
    cut = known.withColumn("starts", starts.cast("int")).withColumn("region", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.filter(~F.col("prose"))
    rows = F.count_if(F.size("segments") >= 2).over(Window.partitionBy(*PAGE, "region"))
    return cut.withColumn("rows", rows).filter(F.col("rows") >= 2).drop("prose", "gap", "pitch", "starts", "rows")


_SPAN = ["doc_id", "span"]
_OPEN = "struct<index: bigint, x0: double, x1: double>"


def _before(sums: DataFrame, what: str) -> DataFrame:
    """The running sum of ``what`` over a document's spans before each one; a span is a row here."""
    earlier = Window.partitionBy("doc_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*_SPAN, F.coalesce(F.sum(what).over(earlier), F.lit(0)).alias("before"))


def _page_places(pages: DataFrame, span_pages: int) -> DataFrame:
    """``(doc_id, page, span, index)``: every page's place in its document, counted per span of pages and shifted."""
    listed = pages.select(*PAGE).distinct().withColumn("span", F.floor(F.col("page") / span_pages))
    starts = _before(listed.groupBy(*_SPAN).count(), "count")
    place = F.row_number().over(Window.partitionBy(*_SPAN).orderBy("page"))
    return listed.withColumn("place", place).join(starts, _SPAN).select(*PAGE, "span", (F.col("before") + F.col("place")).alias("index"))


def _continued(pages: Column, entering: Column) -> Column:
    """A span's pages in order, entered with the table open before them: the table open after them and, per page, whether its first region continues one."""
    def step(acc: Column, p: Column) -> Column:
        open_ = acc["open"]
        inside = F.least(open_["x1"], p["first"]["x1"]) - F.greatest(open_["x0"], p["first"]["x0"])
        wider = F.greatest(open_["x1"] - open_["x0"], p["first"]["x1"] - p["first"]["x0"])
        joins = F.coalesce((p["index"] == open_["index"] + 1) & (inside > 0) & (inside / wider >= SAME_EXTENT), F.lit(False))
        # Only a page's last region stays open; it has grown by what it continues if it is the page's only one.
        grows = joins & (p["regions"] == 1)
        now = F.struct(
            p["index"].alias("index"), F.when(grows, F.least(open_["x0"], p["last"]["x0"])).otherwise(p["last"]["x0"]).alias("x0"),
            F.when(grows, F.greatest(open_["x1"], p["last"]["x1"])).otherwise(p["last"]["x1"]).alias("x1"),
        )
        return F.struct(now.cast(_OPEN).alias("open"), F.concat(acc["joins"], F.array(joins)).alias("joins"))

    return F.aggregate(pages, F.struct(entering.cast(_OPEN).alias("open"), F.array().cast("array<boolean>").alias("joins")), step)


def _carried(spans: DataFrame) -> DataFrame:
    """``spans`` with ``made``, each span entered with the table that the one before leaves open.

    All spans are read at once as if nothing were open; then those are read again whose entering table turns out to be another one, until none is.
    A table that runs on unchanged settles in a round, and no document takes more rounds than it has spans.
    """
    order = Window.partitionBy("doc_id").orderBy("span")
    nothing = F.lit(None).cast(_OPEN)
    now = settled(spans.withColumn("entering", nothing).withColumn("made", _continued(F.col("pages"), nothing)))
    while True:
        left = F.lag("made").over(order)["open"]
        found = F.when(F.get("pages", F.lit(0))["index"] == left["index"] + 1, left)
        seen = now.withColumn("found", found)
        other = ~F.col("found").eqNullSafe(F.col("entering"))
        if seen.filter(other).isEmpty():
            return now.select(*_SPAN, "pages", "made")
        made = F.when(other, _continued(F.col("pages"), F.col("found"))).otherwise(F.col("made"))
        now = settled(seen.select(*_SPAN, "pages", F.col("found").alias("entering"), made.alias("made")))


def link_across_pages(regions: DataFrame, pages: DataFrame, span_pages: int = SPAN_PAGES) -> DataFrame:
    """Lines with ``table_no``: a page's first region continues the last table of the page before it when
    both span the same width.

    A document is cut into spans of pages that are read side by side; only the table open at a span's end is carried into the next.
    Documents without regions have no tables; the order of pages, not their number, says which follow each other.
    """
    multi = F.size("segments") >= 2
    extents = regions.groupBy(*PAGE, "region").agg(F.min(F.when(multi, F.col("x0"))).alias("x0"), F.max(F.when(multi, F.col("x1"))).alias("x1"))
    ranked = settled(extents.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("region"))))
    extent = F.struct("x0", "x1")
    ends = ranked.groupBy(*PAGE).agg(F.count("*").alias("regions"), F.min_by(extent, "rank").alias("first"), F.max_by(extent, "rank").alias("last"))
    per_page = ends.join(_page_places(pages, span_pages), PAGE)
    spans = per_page.groupBy(*_SPAN).agg(F.array_sort(F.collect_list(F.struct("index", "page", "regions", "first", "last"))).alias("pages"))
    spans = settled(spans.withColumn("spans", F.count("*").over(Window.partitionBy("doc_id"))))
    short = spans.filter("spans = 1").select(*_SPAN, "pages", _continued(F.col("pages"), F.lit(None)).alias("made"))
    long = spans.filter("spans > 1").drop("spans")
    done = short if long.isEmpty() else short.unionByName(_carried(long))
    read = done.select(*_SPAN, F.inline(F.transform(F.arrays_zip("pages", F.col("made.joins").alias("joins")), lambda z: F.struct(
        z["pages"]["page"].alias("page"), z["joins"].cast("int").alias("joins"), (z["pages"]["regions"] - z["joins"].cast("int")).alias("opened")))))
    read = settled(read)
    starts = _before(read.groupBy(*_SPAN).agg(F.sum("opened").alias("opened")), "opened")
    earlier = Window.partitionBy(*_SPAN).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("within", F.coalesce(F.sum("opened").over(earlier), F.lit(0))).join(starts, _SPAN)
    numbers = ranked.join(placed, PAGE).select(*PAGE, "region", (F.col("before") + F.col("within") + F.col("rank") - F.col("joins")).cast("int").alias("table_no"))
    return regions.join(numbers, [*PAGE, "region"])


def column_bounds(lines: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(doc_id, table_no, bounds ARRAY<DOUBLE>)``: from vertical rules, else from the gaps no row covers."""
    multi = F.size("segments") >= 2
    facts = lines.groupBy(*TABLE).agg(
        F.min(F.when(multi, F.col("x0"))).alias("left"), F.max(F.when(multi, F.col("x1"))).alias("right"), F.max(F.size("segments")).alias("widest"),
        F.min(F.col("y") - F.col("h")).alias("top"), F.max("y").alias("bottom"), F.min("page").alias("first_page"), F.max("page").alias("last_page"),
    )
    known = lines.join(facts, TABLE)
    header = known.filter(F.size("segments") >= HEADER_WIDTH * F.col("widest")).groupBy(*TABLE).agg(F.min(F.struct("page", "line")).alias("header"))
    body = known.join(header, TABLE).filter(multi & (F.struct("page", "line") >= F.col("header")))
    rows = body.groupBy(*TABLE).agg(F.floor(F.count("*") * COVER_ALLOWED).alias("allowed"))
    # A segment adds one from its first whole place on and takes it off behind its last: two rows each, however wide it is.
    first, behind = F.floor(F.col("x0") - F.col("left")), F.ceil(F.col("x1") - F.col("left"))
    steps = body.select(*TABLE, "left", F.inline("segments")).filter(behind > first).select(
        *TABLE, F.inline(F.array(F.struct(first.alias("x"), F.lit(1).alias("step")), F.struct(behind.alias("x"), F.lit(-1).alias("step"))))
    ).groupBy(*TABLE, "x").agg(F.sum("step").alias("step"))
    along = Window.partitionBy(*TABLE).orderBy("x")
    covered = steps.withColumn("count", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("x").over(along))
    ranges = covered.join(rows, TABLE).filter(F.col("count") > F.col("allowed")).groupBy(*TABLE).agg(
        F.sort_array(F.collect_list(F.struct(F.col("x").alias("from"), "to"))).alias("full"))
    # Between two covered ranges lies a gap; a page is some hundred points wide, so the array is short.
    nexts = F.transform("full", lambda r, i: F.struct(r["to"].alias("a"), F.get("full", i + 1)["from"].alias("b")))
    gaps = F.filter(nexts, lambda g: g["b"].isNotNull() & (g["b"] - g["a"] >= MIN_COLUMN_GAP))
    spaces = ranges.join(facts, TABLE).select(
        *TABLE, F.transform(gaps, lambda g: F.col("left") + (g["a"] + g["b"]) / 2).cast("array<double>").alias("spaces")
    )
    if rules is None:
        return facts.join(spaces, TABLE, "left").select(*TABLE, F.coalesce("spaces", F.array().cast("array<double>")).alias("bounds"))
    upright = rules.filter(F.abs(F.col("x1") - F.col("x0")) < RULE_WIDTH).select(
        "doc_id", F.col("page").alias("first_page"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.least("y0", "y1").alias("from"), F.greatest("y0", "y1").alias("to")
    )
    single = facts.filter(F.col("first_page") == F.col("last_page"))
    reach = F.least("bottom", "to") - F.greatest("top", "from")
    through = single.join(upright, ["doc_id", "first_page"]).filter(
        (reach >= RULE_COVER * (F.col("bottom") - F.col("top"))) & (F.col("x") > F.col("left") + 1) & (F.col("x") < F.col("right") - 1)
    )
    apart = through.groupBy(*TABLE).agg(F.sort_array(F.collect_list("x")).alias("xs")).select(*TABLE, F.aggregate(
        "xs", F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) > RULE_APART), F.concat(acc, F.array(x))).otherwise(acc),
    ).alias("ruled"))
    return facts.join(spaces, TABLE, "left").join(apart, TABLE, "left").select(
        *TABLE, F.coalesce("ruled", "spaces", F.array().cast("array<double>")).alias("bounds")
    )


def _column_of(s: Column) -> Column:
    return F.size(F.filter("bounds", lambda b: b < (s["x0"] + s["x1"]) / 2))


def line_cells(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(doc_id, table_no, page, line, y, h, cells, boxes)``: segments dealt into columns by their centre, with how far each column's reach and their lowest confidence."""
    dealt = lines.join(bounds, TABLE).withColumn("parts", F.transform(
        F.sequence(F.lit(0), F.size("bounds")), lambda c: F.filter("segments", lambda s: _column_of(s) == c)))
    cells = F.transform("parts", lambda p: F.nullif(F.array_join(F.transform(p, lambda s: s["text"]), " "), F.lit("")))
    boxes = F.transform("parts", lambda p: F.struct(
        F.array_min(F.transform(p, lambda s: s["x0"])).alias("x0"), F.array_max(F.transform(p, lambda s: s["x1"])).alias("x1"),
        F.array_min(F.transform(p, lambda s: s["conf"])).alias("conf")))
    return dealt.select(*TABLE, "page", "line", "y", "h", cells.alias("cells"), boxes.alias("boxes"))


def merge_wrapped(cells: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """Rows whose text only continues the row above are merged into it; ``merged`` counts them per row."""
    order = Window.partitionBy(*TABLE, "page").orderBy("line")
    spaced = cells.withColumn("gap", F.col("y") - F.lag("y").over(order))
    pitch = spaced.groupBy(*TABLE).agg(F.coalesce(F.nullif(F.median("gap"), F.lit(0.0)), F.lit(DEFAULT_PITCH)).alias("pitch"))
    known = spaced.join(pitch, TABLE)
    filled = F.filter("cells", lambda c: c.isNotNull())
    thin = (
        (F.size(filled) > 0) & (F.size(filled) * 2 < F.size("cells")) & ~F.exists(filled, is_value)
        & F.coalesce(F.col("gap") <= WRAP_GAP * F.col("pitch"), F.lit(False))
    )
    # Only a thin row can continue another one, so a full row with no thin row after it needs no folding; most rows take this way and never leave the JVM.
    follows = F.coalesce(F.lead("thin").over(order), F.lit(False))
    known = known.withColumn("thin", thin).select(*TABLE, "page", "line", "cells", F.transform("cells", is_value).alias("values"), "thin")
    marked = (tables or Scratch(cells.sparkSession)).stored(known.withColumn("wraps", F.col("thin") | follows), "marked")
    kinds = dict(known.dtypes)
    keys = [*TABLE, "page", "line"]
    names = [*keys, "cells", "merged"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The open row: its keys, the parts of each cell, whether text may be added to it, and what was merged.
        open_, page, out, types = None, None, [], None

        def closed() -> tuple:
            at, parts, _, merged = open_
            return (*at, [" ".join(c) if c else None for c in parts], merged)

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            types = [*[batch.schema.field(i).type for i in range(len(keys))], pa.list_(pa.string()), pa.int32()]
            for doc_id, table_no, number, line, cells_, values, is_thin in zip(*(c.to_pylist() for c in batch.columns)):
                here = [i for i, c in enumerate(cells_) if c is not None]
                if open_ is not None and is_thin and page == (doc_id, table_no, number) and all(open_[2][i] for i in here):
                    for i in here:
                        open_[1][i].append(cells_[i])
                    open_[3] += 1
                    continue
                if open_ is not None:
                    out.append(closed())
                page = (doc_id, table_no, number)
                open_ = [(*page, line), [[] if c is None else [c] for c in cells_], [c is not None and not v for c, v in zip(cells_, values)], 0]
            if out:
                yield made()
        if open_ is not None:
            out.append(closed())
            yield made()

    # Rows pass through a task as a stream in their order: what is held is the row that may still be continued.
    streamed = marked.filter("wraps").select(*keys, "cells", "values", "thin").repartition(*TABLE, "page").sortWithinPartitions(*keys)
    folded = streamed.mapInArrow(run, f"doc_id {kinds['doc_id']}, table_no {kinds['table_no']}, page {kinds['page']}, line {kinds['line']}, cells array<string>, merged int")
    plain = marked.filter(~F.col("wraps")).select(*keys, "cells", F.lit(0).alias("merged"))
    return plain.unionByName(folded)


def cell_boxes(lines: DataFrame, rows: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """``(doc_id, table_no, row STRUCT<page, line>, col, page, text, x0, y0, x1, y1, conf)``: filled cells with the box around their segments.

    ``lines`` are those of ``line_cells``, ``rows`` the merged rows: the lines that were merged into a row widen the boxes of its cells. A cell's confidence is its
    lowest segment's. Empty cells have no box.
    """
    keys = [*TABLE, "page", "line"]
    owned = lines.select(*keys, "y", "h", "boxes").join(rows.select(*keys, F.col("cells").alias("texts"), "merged"), keys, "left")
    owned = (tables or Scratch(lines.sparkSession)).stored(owned, "owned")

    def cells(some: DataFrame) -> DataFrame:
        return some.select(*keys, (F.col("y") - F.col("h")).alias("y0"), (F.col("y") + BELOW_BASE * F.col("h")).alias("y1"), F.inline(
            F.transform("boxes", lambda b, i: F.struct(
                i.alias("col"), F.get("texts", i).alias("text"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["conf"].alias("conf")))))

    # A row of one line has its boxes there. Only the lines of merged rows are brought together: a head and those after it that are no rows.
    single = cells(owned.filter("merged = 0"))
    order = Window.partitionBy(*TABLE, "page").orderBy("line")
    head = F.last(F.when(F.col("merged") > 0, F.col("line")), ignorenulls=True).over(order)
    parts = cells(owned.filter("merged > 0 OR merged IS NULL").withColumn("line", head))
    found = F.col("x0").isNotNull()
    several = parts.groupBy(*keys, "col").agg(
        F.min(F.when(found, F.col("y0"))).alias("y0"), F.max(F.when(found, F.col("y1"))).alias("y1"), F.max("text").alias("text"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("conf").alias("conf"),
    )
    return single.unionByName(several).filter(F.col("text").isNotNull()).select(
        *TABLE, F.struct("page", "line").alias("row"), "col", "page", "text", "x0", "y0", "x1", "y1", "conf"
    )


@dataclass(frozen=True)
class Layout:
    """What several steps read of a set of pages, each written once."""

    lines: DataFrame  # all lines, with ``furniture``
    cells: DataFrame  # lines of tables, dealt into columns, see ``line_cells``
    rows: DataFrame  # ``(doc_id, table_no, page, line, cells, merged)``


def lay_out(glyphs: DataFrame, pages: DataFrame, rules: DataFrame | None = None, tables: Scratch | None = None) -> Layout:
    """Page text to lines, tables and merged rows; ``tables`` holds ``lines``, ``cells`` and ``marked``, which what is returned reads."""
    tables = tables or Scratch(glyphs.sparkSession)
    lines = drop_page_furniture(page_lines(glyphs), pages, tables)
    regions = tables.stored(page_regions(lines).drop("width", "furniture"), "regions")
    linked = tables.stored(link_across_pages(regions, pages).drop("region"), "linked")
    tables.drop("regions")
    bounds = tables.stored(column_bounds(linked, rules), "bounds")
    cells = tables.stored(line_cells(linked, bounds), "cells")
    tables.drop("linked", "bounds")
    return Layout(lines, cells, merge_wrapped(cells, tables))


def extract_tables(glyphs: DataFrame, pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(doc_id, table_no, page, line, cells, merged)``: page text to table rows in reading order."""
    tables = Scratch(glyphs.sparkSession)
    rows = lay_out(glyphs, pages, rules, tables).rows
    tables.drop("lines", "cells")
    return rows


def extract_cells(glyphs: DataFrame, pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Page text to table cells with their boxes, see ``cell_boxes``, as a written table; ``second_readings`` takes them."""
    tables = Scratch(glyphs.sparkSession)
    made = lay_out(glyphs, pages, rules, tables)
    tables.drop("lines")
    rows = tables.stored(made.rows, "rows")
    tables.drop("marked")
    boxes = cell_boxes(made.cells, rows, tables)
    tables.drop("cells", "rows")
    done = tables.stored(boxes, "boxes")
    tables.drop("owned")
    return done


def layout_report(layout: Layout, glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, pages, ocr_pages, furniture_lines, tables, merged_rows)`` for every document that has a page."""
    seen = pages.select(*PAGE).distinct()
    counts = needs_ocr(glyphs, seen).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("needs_ocr").alias("ocr_pages"))
    dropped = layout.lines.groupBy("doc_id").agg(F.count_if("furniture").alias("furniture_lines"))
    # Rows of a table first, so that a long document is a few rows before its tables are counted.
    tables = layout.rows.groupBy(*TABLE).agg(F.sum("merged").alias("merged")).groupBy("doc_id").agg(
        F.count("*").alias("tables"), F.sum("merged").alias("merged_rows")
    )
    return counts.join(dropped, "doc_id", "left").join(tables, "doc_id", "left").na.fill(0)


def to_sheet_rows(tables: DataFrame) -> DataFrame:
    """Table rows as ``(file_id, row_idx, cells)`` for the tidying."""
    return tables.select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("table_no").cast("string")).alias("file_id"),
        F.struct("page", "line").alias("row_idx"), F.transform("cells", lambda c: F.nullif(F.trim(c), F.lit(""))).alias("cells"),
    )


def found_tables(report: DataFrame) -> DataFrame:
    """Tables worth keeping after tidying (two columns and one row at least), numbered per document."""
    kept = report.filter((F.col("column_count") >= 2) & (F.col("row_count") > 0))
    doc, no = F.split_part("file_id", F.lit("/"), F.lit(1)), F.split_part("file_id", F.lit("/"), F.lit(2)).cast("int")
    order = Window.partitionBy("doc_id").orderBy("table_no")
    return kept.select("file_id", doc.alias("doc_id"), no.alias("table_no"), "row_count", "column_count").withColumn("name", F.row_number().over(order))


def needs_ocr(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages without a usable text layer."""
    chars = glyphs.groupBy(*PAGE).agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    return pages.select(*PAGE).join(chars, PAGE, "left").select(*PAGE, (F.coalesce("chars", F.lit(0)) < OCR_CHARS).alias("needs_ocr"))
