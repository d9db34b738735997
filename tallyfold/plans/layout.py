"""Printed reports derived from the orders: positioned text, tables rebuilt from it, and readings cross-checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators import pages as G
from tallyfold.operators import readings as R
from tallyfold.operators import tidy as T
from tallyfold.plans.registry import Tables, query
from tallyfold.plans.recovery import local_number
from tallyfold.session import Scratch, settled

ROWS = 8


def numbered_orders(t: Tables) -> DataFrame:
    """The orders of each customer (some ten) with their place in the customer's report."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return t.orders.withColumn("n", n).withColumn("page", (F.floor(F.col("n") / ROWS) + 1).cast("int"))


def _item(text: Column, x0: float, y: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(x0).alias("x0"), (F.lit(x0) + F.length(text) * 5.0).alias("x1"), y.cast("double").alias("y"))


def report_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A report per customer: a heading on every page, eight orders per page, a page number below.

    Order number and status share one text item, aligned by spaces; some statuses run on in a second line.
    """
    rows = numbered_orders(t)
    y = F.lit(144) + F.col("n") % ROWS * 24
    left = F.concat(F.rpad(F.col("o_orderkey").cast("string"), 14, " "), F.lit("Durum "), F.col("o_orderstatus"))
    items = F.filter(F.array(
        _item(left, 40.0, y), _item(local_number(F.col("o_totalprice")), 260.0, y), _item(F.date_format("o_orderdate", "dd.MM.yyyy"), 400.0, y),
        F.when(F.col("o_orderkey") % 11 == 0, _item(F.lit("devamı"), 110.0, y + 12)),
    ), lambda i: i.isNotNull())
    body = rows.select(F.col("o_custkey").alias("doc_id"), "page", F.inline(items))
    pages = rows.groupBy(F.col("o_custkey").alias("doc_id"), "page").agg(F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    counts = rows.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max("page").alias("last"))
    frame = pages.join(counts, "doc_id").select("doc_id", "page", F.inline(F.array(
        _item(F.lit("Sipariş"), 40.0, F.lit(120)), _item(F.lit("Durumu"), 110.0, F.lit(120)), _item(F.lit("Tutar"), 260.0, F.lit(120)),
        _item(F.lit("Tarih"), 400.0, F.lit(120)),
        _item(F.concat(F.lit("Sayfa "), F.col("page").cast("string"), F.lit(" / "), F.col("last").cast("string")), 260.0, F.lit(830)),
    )))
    glyphs = body.unionByName(frame).select("*", F.lit(10.0).alias("h"), F.lit(100.0).alias("conf"))
    return glyphs, pages


N = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)"
LOCAL = "replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '_'), '.', ','), '_', '.')"
REPORT = f"""SELECT o_custkey AS doc_id, CAST(n // 8 + 1 AS INT) AS page, o_orderkey || '|Durum ' || o_orderstatus ||
        CASE WHEN o_orderkey % 11 = 0 THEN ' devamı' ELSE '' END || '|' || {LOCAL} || '|' || strftime(o_orderdate, '%d.%m.%Y') AS cells FROM {N}"""


@query("split_spaced", f"""
    SELECT o_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS text, 40.0::DOUBLE AS x0 FROM orders
    UNION ALL SELECT o_custkey, 'Durum ' || o_orderstatus, 110.0 FROM orders""")
def split_spaced(t: Tables) -> DataFrame:
    glyphs, _ = report_pages(t)
    # All glyphs go through; those compared are the parts of the first two columns.
    parts = G.split_spaced(glyphs).filter(F.col("text").rlike(r"^(?:\d+|Durum [A-Z])\z") & (F.col("x0") < 150))
    return parts.select("doc_id", "text", F.round("x0", 6).alias("x0"))


@query("page_lines", f"""
    SELECT o_custkey AS doc_id, CAST(n // 8 + 1 AS INT) AS page, count(*) + count(*) FILTER (o_orderkey % 11 = 0) + 2 AS lines,
           4 * count(*) + count(*) FILTER (o_orderkey % 11 = 0) + 5 AS segments FROM {N} GROUP BY 1, 2""")
def page_lines(t: Tables) -> DataFrame:
    lines = G.page_lines(report_pages(t)[0])
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.sum(F.size("segments")).alias("segments"))


@query("page_furniture", f"SELECT DISTINCT o_custkey AS doc_id, CAST(n // 8 + 1 AS INT) AS page, 1 AS dropped, 830.0::DOUBLE AS y FROM {N}")
def page_furniture(t: Tables) -> DataFrame:
    glyphs, pages = report_pages(t)
    lines = G.drop_page_furniture(G.page_lines(glyphs), pages).filter("furniture")
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("dropped"), F.max("y").alias("y"))


@query("page_regions", f"""
    SELECT o_custkey AS doc_id, CAST(n // 8 + 1 AS INT) AS page, 1 AS table_no, count(*) + count(*) FILTER (o_orderkey % 11 = 0) + 1 AS lines FROM {N} GROUP BY 1, 2""")
def page_regions(t: Tables) -> DataFrame:
    """Regions of every page, linked to one table per document."""
    glyphs, pages = report_pages(t)
    linked = G.link_across_pages(settled(G.page_regions(G.drop_page_furniture(G.page_lines(glyphs), pages))), pages)
    return linked.groupBy("doc_id", "page", "table_no").agg(F.count("*").alias("lines"))


@query("page_tables", f"""
    SELECT doc_id, 1 AS table_no, page, cells FROM ({REPORT})
    UNION ALL SELECT DISTINCT o_custkey, 1, CAST(n // 8 + 1 AS INT), 'Sipariş|Durumu|Tutar|Tarih' FROM {N}""")
def page_tables(t: Tables) -> DataFrame:
    rows = G.extract_tables(*report_pages(t))
    return rows.select("doc_id", "table_no", "page", F.array_join("cells", "|", "∅").alias("cells"))


@query("found_tables", f"SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 1 AS name, count(*) AS row_count, 4 AS column_count FROM {N} GROUP BY 1")
def found_tables(t: Tables) -> DataFrame:
    """The rebuilt tables tidied: repeated headings of later pages are gone."""
    sheets = settled(G.to_sheet_rows(G.extract_tables(*report_pages(t))))
    return G.found_tables(T.tidy(sheets).report).select("doc_id", "name", "row_count", "column_count")


@query("needs_ocr", """
    SELECT doc_id, 1 AS page, doc_id % 7 = 0 OR list_sum(list_transform(string_split(text, chr(10)), lambda l: length(trim(l)))) < 10 AS needs_ocr FROM documents""")
def needs_ocr(t: Tables) -> DataFrame:
    """Every document as a page of its lines; every seventh has no text layer."""
    lines = t.documents.filter(F.col("doc_id") % 7 != 0).select("doc_id", F.lit(1).alias("page"), F.explode(F.split("text", "\n", -1)).alias("text"))
    pages = t.documents.select("doc_id", F.lit(1).alias("page"))
    return G.needs_ocr(lines, pages)


# ---- readings ----------------------------------------------------------------------------------------------


def order_readings(t: Tables) -> DataFrame:
    """Recognised amounts per customer: a g for a 9, a wrong digit that the others outvote, and one nobody confirms."""
    price, kind = F.col("o_totalprice"), F.col("o_orderkey") % 10
    right, wrong, other = (local_number(price + k) for k in (0, 1, 2))
    first = F.when(kind == 1, F.translate(right, "9", "g")).when(kind.isin(2, 3), wrong).otherwise(right)
    rows = numbered_orders(t).select(F.col("o_custkey").alias("doc_id"), (F.col("n") + 1).alias("row"), F.inline(F.filter(F.array(
        F.struct(F.lit(0).alias("col"), F.lit(1).alias("engine"), F.concat(F.lit("Sipariş "), F.col("o_orderstatus")).alias("text")),
        F.struct(F.lit(1).alias("col"), F.lit(1).alias("engine"), first.alias("text")),
        F.struct(F.lit(1).alias("col"), F.lit(2).alias("engine"), right.alias("text")),
        F.struct(F.lit(1).alias("col"), F.lit(3).alias("engine"), F.when(kind == 2, right).when(kind == 3, other).alias("text")),
    ), lambda r: r["text"].isNotNull())))
    head = t.orders.select(F.col("o_custkey").alias("doc_id")).distinct().select(
        "doc_id", F.lit(0).alias("row"), F.inline(F.array(
            F.struct(F.lit(0).alias("col"), F.lit(1).alias("engine"), F.lit("Durum").alias("text")),
            F.struct(F.lit(1).alias("col"), F.lit(1).alias("engine"), F.lit("Tutar").alias("text")),
        )))
    return rows.unionByName(head).withColumn("conf", F.lit(90.0))


WRONG = LOCAL.replace("o_totalprice", "o_totalprice + 1")
VOTES = f"""(SELECT o_custkey AS doc_id, n + 1 AS row, 1 AS col, CASE WHEN o_orderkey % 10 = 3 THEN {WRONG} || ' (?)' ELSE {LOCAL} END AS text, true AS checked,
        (o_orderkey % 10 = 1 AND contains({LOCAL}, '9')) OR o_orderkey % 10 = 2 AS corrected, o_orderkey % 10 = 3 AS uncertain FROM {N}
    UNION ALL SELECT o_custkey, n + 1, 0, 'Sipariş ' || o_orderstatus, false, false, false FROM {N}
    UNION ALL SELECT DISTINCT o_custkey, 0, 0, 'Durum', false, false, false FROM orders
    UNION ALL SELECT DISTINCT o_custkey, 0, 1, 'Tutar', false, false, false FROM orders)"""


@query("reading_vote", f"SELECT * FROM {VOTES}")
def reading_vote(t: Tables) -> DataFrame:
    return R.reading_vote(order_readings(t))


@query("reading_report", f"""
    SELECT doc_id, count(*) FILTER (checked) AS checked_cells, count(*) FILTER (corrected) AS corrected_cells, count(*) FILTER (uncertain) AS uncertain_cells,
           count(*) FILTER (row % 4 = 1 AND col = 0) AS low_confidence_words FROM {VOTES} GROUP BY 1""")
def reading_report(t: Tables) -> DataFrame:
    readings = order_readings(t)
    words = readings.filter((F.col("engine") == 1) & (F.col("col") == 0)).select("doc_id", F.when(F.col("row") % 4 == 1, 55.0).otherwise(90.0).alias("conf"))
    return R.reading_report(words, R.reading_vote(readings))


@query("second_readings", f"SELECT o_custkey AS doc_id, n AS row, 1 AS col, 2 AS engine, o_orderstatus || ' ' || {LOCAL} AS text FROM {N}")
def second_readings(t: Tables) -> DataFrame:
    """Two words inside each cell's box, and one beside it."""
    rows = numbered_orders(t).withColumn("y", F.col("n") * 20.0)
    boxes = rows.select(F.col("o_custkey").alias("doc_id"), F.col("n").alias("row"), F.lit(1).alias("col"), F.lit(1).alias("page"),
                        F.lit(100.0).alias("x0"), F.lit(200.0).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 12).alias("y1"))
    words = rows.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.inline(F.array(
        F.struct(local_number(F.col("o_totalprice")).alias("text"), F.lit(140.0).alias("x0"), F.lit(190.0).alias("x1")),
        F.struct(F.col("o_orderstatus").alias("text"), F.lit(105.0).alias("x0"), F.lit(115.0).alias("x1")),
        F.struct(F.lit("beside").alias("text"), F.lit(205.0).alias("x0"), F.lit(250.0).alias("x1")),
    )), (F.col("y") + 11).alias("y"), F.lit(10.0).alias("h"))
    return R.second_readings(boxes, words)


@query("restore_letters", """
    SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'Beşiktaş' WHEN 1 THEN 'Besiktas' ELSE '5O' END AS text, c_custkey % 3 = 0 AS restored FROM customer""")
def restore_letters(t: Tables) -> DataFrame:
    kind = F.col("c_custkey") % 3

    def words(text: Column) -> DataFrame:
        return t.customer.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("seq"), text.alias("text"),
                                 F.lit(10.0).alias("x0"), F.lit(35.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(45.0).alias("y1"))

    main = words(F.when(kind == 2, "5O").otherwise("Besiktas"))
    letters = words(F.when(kind == 0, "Beşiktaş").when(kind == 1, "Bakırköy").otherwise("50"))
    return R.restore_letters(main, letters).select("doc_id", "text", "restored")


# ---- from glyphs to voted cells ------------------------------------------------------------------------------


def ruled_pages(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Glyphs, pages, rules and the words of two further readings: every page of a report as a document of its own.

    Two drawn rules leave three columns, so order number and status are one cell although a gap lies between them. The first reading takes a 9 for a g,
    or reads an amount wrongly; the second is right; the third sides with the second, or with nobody.
    """
    doc_id = (F.col("o_custkey") * 100_000 + F.col("page")).cast("bigint").alias("doc_id")
    rows = numbered_orders(t).select(doc_id, "*").withColumn("y", F.lit(144) + F.col("n") % ROWS * 24)
    kind, price = F.col("o_orderkey") % 10, F.col("o_totalprice")
    right, wrong, other = (local_number(price + k) for k in (0, 1, 2))
    first = F.when(kind == 1, F.translate(right, "9", "g")).when(kind.isin(2, 3), wrong).otherwise(right)
    more = F.when(F.col("o_orderkey") % 11 == 0, _item(F.lit("devamı"), 110.0, F.col("y") + 12))

    def items(*amounts: Column) -> Column:
        all_of = [
            _item(F.col("o_orderkey").cast("string"), 40.0, F.col("y")), _item(F.concat(F.lit("Durum "), F.col("o_orderstatus")), 110.0, F.col("y")),
            *[_item(a, 260.0, F.col("y")) for a in amounts], _item(F.date_format("o_orderdate", "dd.MM.yyyy"), 400.0, F.col("y")), more,
        ]
        return F.filter(F.array(*all_of), lambda i: i.isNotNull())

    one = F.lit(1).alias("page")
    heads = rows.filter(F.col("n") % ROWS == 0).select("doc_id")
    titles = F.array(*[_item(F.lit(title), x, F.lit(120)) for title, x in (("Sipariş", 40.0), ("Durumu", 110.0), ("Tutar", 260.0), ("Tarih", 400.0))])
    glyphs = rows.select("doc_id", one, F.inline(items(first))).unionByName(heads.select("doc_id", one, F.inline(titles)))
    glyphs = glyphs.select("*", F.lit(10.0).alias("h"), F.lit(90.0).alias("conf"))
    pages = heads.select("doc_id", one, F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    rules = heads.select("doc_id", one, F.explode(F.array(F.lit(250.0), F.lit(390.0))).alias("x0")).select(
        "*", F.col("x0").alias("x1"), F.lit(100.0).alias("y0"), F.lit(400.0).alias("y1"))
    second = rows.select("doc_id", one, F.lit(2).alias("engine"), F.inline(items(right)))
    third = rows.filter(kind.isin(2, 3)).select("doc_id", one, F.lit(3).alias("engine"), F.inline(F.array(_item(F.when(kind == 2, right).otherwise(other), 260.0, F.col("y")))))
    return glyphs, pages, rules, second.unionByName(third).withColumn("h", F.lit(10.0))


def _cell_sql(col: int, text: str, checked: str = "true", corrected: str = "false", uncertain: str = "false") -> str:
    at = "o_custkey * 100000 + n // 8 + 1 AS doc_id"
    return f"SELECT {at}, o_orderkey, {col} AS col, {text} AS text, {checked} AS checked, {corrected} AS corrected, {uncertain} AS uncertain FROM {N}"


STATUS_CELL = "o_orderkey || ' Durum ' || o_orderstatus || CASE WHEN o_orderkey % 11 = 0 THEN ' devamı' ELSE '' END"
VOTED = f"""({_cell_sql(0, STATUS_CELL, "false")} UNION ALL {_cell_sql(2, "strftime(o_orderdate, '%d.%m.%Y')")}
    UNION ALL {_cell_sql(1, f"CASE WHEN o_orderkey % 10 = 3 THEN {WRONG} || ' (?)' ELSE {LOCAL} END", "true",
                         f"(o_orderkey % 10 = 1 AND contains({LOCAL}, '9')) OR o_orderkey % 10 = 2", "o_orderkey % 10 = 3")})"""


@query("voted_cells", f"""
    SELECT doc_id, col, text, checked, corrected, uncertain FROM {VOTED}
    UNION ALL SELECT DISTINCT o_custkey * 100000 + n // 8 + 1, v.col, v.text, false, false, false FROM {N},
        (VALUES (0, 'Sipariş Durumu'), (1, 'Tutar'), (2, 'Tarih')) v(col, text)""")
def voted_cells(t: Tables) -> DataFrame:
    """Page text to a ruled table, its cells' boxes, what further readings say inside them, and the vote."""
    glyphs, pages, rules, words = ruled_pages(t)
    boxes = G.extract_cells(glyphs, pages, rules)
    first = boxes.select("doc_id", "table_no", "row", "col", F.lit(1).alias("engine"), "text")
    readings = first.unionByName(Scratch(t.spark).stored(R.second_readings(boxes, words, None), "second-readings"))
    return R.reading_vote(readings).select("doc_id", "col", "text", "checked", "corrected", "uncertain")


@query("cell_boxes", f"""
    SELECT o_custkey * 100000 + n // 8 + 1 AS doc_id, v.col, v.x0, 134.0 + n % 8 * 24 AS y0,
           147.0 + n % 8 * 24 + CASE WHEN v.col = 0 AND o_orderkey % 11 = 0 THEN 12 ELSE 0 END AS y1, 90.0::DOUBLE AS conf
    FROM {N}, (VALUES (0, 40.0), (1, 260.0), (2, 400.0)) v(col, x0)
    UNION ALL SELECT DISTINCT o_custkey * 100000 + n // 8 + 1, v.col, v.x0, 110.0, 123.0, 90.0 FROM {N}, (VALUES (0, 40.0), (1, 260.0), (2, 400.0)) v(col, x0)""")
def cell_boxes(t: Tables) -> DataFrame:
    glyphs, pages, rules, _ = ruled_pages(t)
    return G.extract_cells(glyphs, pages, rules).select("doc_id", "col", "x0", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"), "conf")


@query("layout_report", f"""
    SELECT o_custkey AS doc_id, max(n // 8 + 1) + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS pages, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS ocr_pages,
           max(n // 8 + 1) AS furniture_lines, 1 AS tables, count(*) FILTER (o_orderkey % 11 = 0) AS merged_rows FROM {N} GROUP BY o_custkey""")
def layout_report(t: Tables) -> DataFrame:
    """Pages, pages without text, dropped and merged lines per report; every fifth report ends with a page without text."""
    glyphs, pages = report_pages(t)
    blank = pages.filter(F.col("doc_id") % 5 == 0).groupBy("doc_id", "width", "height").agg((F.max("page") + 1).alias("page"))
    pages = pages.unionByName(blank)
    made = G.lay_out(glyphs, pages)
    return G.layout_report(made, glyphs, pages)
