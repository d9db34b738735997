"""Results shaped for charts and tables, and the facts behind their takeaways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import facts as K
from tallyfold.operators import query as Q
from tallyfold.operators import shape as S
from tallyfold.plans.questions import ORDER_PRICE, cents, total
from tallyfold.plans.registry import Tables, query


def yearly(t: Tables) -> DataFrame:
    """Units per year and part type, as a long series."""
    lines = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), Q.period_text(F.col("l_shipdate"), "year").alias("x")).agg(F.sum("l_quantity").alias("y"))
    return lines.join(t.part.select("p_partkey", F.col("p_type").alias("series")), "p_partkey").groupBy("x", "series").agg(F.sum("y").alias("y"))


YEARLY = "(SELECT strftime(l_shipdate, '%Y') AS x, p_type AS series, CAST(sum(l_quantity) AS DOUBLE) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def monthly(t: Tables) -> DataFrame:
    return t.orders.groupBy(Q.period_text(F.col("o_orderdate"), "month").alias("x")).agg(total(cents("o_totalprice")).alias("y"))


MONTHLY = f"(SELECT strftime(o_orderdate, '%Y-%m') AS x, CAST(sum({ORDER_PRICE}) AS DOUBLE) AS y FROM orders GROUP BY 1)"


def brands(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.sum(cents("p_retailprice")).alias("amount"))


BRANDS = "(SELECT p_brand, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS amount FROM part GROUP BY 1)"


@query("grain_check", """
    SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders GROUP BY ALL HAVING count(*) > 1""")
def grain_check(t: Tables) -> DataFrame:
    """Raw orders are not aggregated to priority and status: every pair repeats."""
    return S.repeated_cells(t.orders, "o_orderpriority", "o_orderstatus")


@query("series_pivot", f"""
    WITH y AS (SELECT * FROM {YEARLY}), r AS (SELECT series, row_number() OVER (ORDER BY sum(abs(y)) DESC, series) - 1 AS k FROM y GROUP BY 1)
    SELECT x, {', '.join(f'max(y) FILTER (k = {i}) AS s{i}' for i in range(6))} FROM y JOIN r USING (series) GROUP BY 1""")
def series_pivot(t: Tables) -> DataFrame:
    return S.series_pivot(yearly(t), "x", "series", "y")


FOLDED = f"""(WITH r AS (SELECT *, row_number() OVER (ORDER BY amount DESC, p_brand) AS rn FROM {BRANDS})
    SELECT CASE WHEN rn > 6 THEN 'Diğer' ELSE p_brand END AS name, CAST(sum(amount) AS DOUBLE) AS value,
           CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM r) AS share FROM r GROUP BY 1)"""


@query("fold_other", f"SELECT * FROM {FOLDED}")
def fold_other(t: Tables) -> DataFrame:
    return S.fold_other(brands(t), "p_brand", "amount")


@query("pie_facts", f"""
    SELECT name, value, share, (SELECT CAST(sum(amount) AS DOUBLE) FROM {BRANDS}) AS total FROM {FOLDED}
    WHERE name = (SELECT p_brand FROM {BRANDS} ORDER BY amount DESC, p_brand LIMIT 1)""")
def pie_facts(t: Tables) -> DataFrame:
    return K.pie_facts(brands(t), "p_brand", "amount").withColumn("total", F.round("total", 2))


@query("table_totals", """
    SELECT 'amount' AS "column", CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer
    UNION ALL SELECT 'customers', CAST(count(*) AS DOUBLE) FROM customer""")
def table_totals(t: Tables) -> DataFrame:
    rows = t.customer.groupBy("c_nationkey").agg(total(cents("c_acctbal")).alias("amount"), F.count("*").alias("customers"))
    return S.table_totals(rows, ["amount", "customers"]).withColumn("total", F.round("total", 2))


@query("format_check", """
    SELECT * FROM (VALUES ('o_orderkey', 'integer', 'integer'), ('o_orderstatus', 'currency', 'text'), ('o_orderdate', 'date', 'date'),
        ('o_totalprice', 'text', 'number'), ('nothing', 'percent', 'percent'), ('o_orderpriority', NULL, 'text')) v("column", declared, format)""")
def format_check(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", F.lit(None).cast("string").alias("nothing"), "o_orderpriority")
    declared = {"o_orderkey": "integer", "o_orderstatus": "currency", "o_orderdate": "date", "o_totalprice": "text", "nothing": "percent"}
    return S.format_check(rows, declared)


BY_PRIORITY = "(SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m, o_orderpriority FROM orders)"


@query("valid_views", f"""
    SELECT 'months' AS result, count(*) AS rows, false AS metric, count(*) <= 30 AS bar, count(*) <= 2000 AS line, min(y) >= 0 AS pie, true AS "table", 'line' AS default_view FROM {MONTHLY}
    UNION ALL SELECT 'brands', count(*), false, count(*) <= 30, false, true, true, 'bar' FROM {BRANDS}
    UNION ALL SELECT 'one', 1, true, false, false, false, true, 'metric'
    UNION ALL SELECT 'raw', count(*), false, false, false, false, true, 'table' FROM orders
    UNION ALL SELECT 'balances', count(*), false, true, false, min(b) >= 0, true, 'bar' FROM (SELECT c_mktsegment, min(c_acctbal) AS b FROM customer GROUP BY 1)
    UNION ALL SELECT 'months by priority', count(*), false, count(DISTINCT m) <= 30, true, false, true, 'line' FROM {BY_PRIORITY}
    UNION ALL SELECT 'priority by status', count(*), false, true, false, false, true, 'bar' FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)
    UNION ALL SELECT 'priority by month', count(*), false, false, false, false, true, 'table' FROM {BY_PRIORITY}""")
def valid_views(t: Tables) -> DataFrame:
    """A dated line, categories, one number, rows that are not aggregated, negative values, and two dimensions with few and with too many labels."""
    by_priority = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    by_status = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("s"))
    cases = {
        "months": (monthly(t), ["y"]), "brands": (brands(t), ["amount"]), "one": (t.orders.agg(F.max("o_totalprice").alias("m")), ["m"]),
        "raw": (t.orders.select("o_orderpriority", "o_totalprice"), []),
        "balances": (t.customer.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("b")), ["b"]),
        "months by priority": (by_priority, ["s"], "m", "o_orderpriority"), "priority by status": (by_status, ["s"], "o_orderpriority", "o_orderstatus"),
        "priority by month": (by_priority, ["s"], "o_orderpriority", "m"),
    }
    out = None
    for name, (df, summable, *axes) in cases.items():
        x, series = axes or (None, None)
        flags = S.valid_views(df, summable, x=x, series=series).select(F.lit(name).alias("result"), "*")
        out = flags if out is None else out.unionByName(flags)
    return out


@query("page_rows", """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_no,
           (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 25 AS page FROM orders""")
def page_rows(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return S.page_rows(rows, [F.desc("o_totalprice"), "o_orderkey"]).drop("o_totalprice")


@query("bar_facts", f"""
    SELECT count(*) AS points, arg_max(p_brand, amount) AS max_x, CAST(max(amount) AS DOUBLE) AS max_value, arg_min(p_brand, amount) AS min_x,
           CAST(min(amount) AS DOUBLE) AS min_value, CAST(sum(amount) AS DOUBLE) AS total, false AS all_equal,
           (CAST(max(amount) AS DOUBLE) - CAST(min(amount) AS DOUBLE)) / CAST(min(amount) AS DOUBLE) AS difference FROM {BRANDS}""")
def bar_facts(t: Tables) -> DataFrame:
    return K.bar_facts(brands(t), "p_brand", "amount", summable=True).withColumn("total", F.round("total", 2))


STATUSES = "(SELECT o_orderpriority AS x, o_orderstatus AS s, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders GROUP BY 1, 2)"


@query("bar_facts_series", f"""
    SELECT count(*) AS points, arg_max(x, y) AS max_x, arg_max(s, y) AS max_series, max(y) AS max_value, arg_min(x, y) AS min_x, arg_min(s, y) AS min_series,
           min(y) AS min_value, (max(y) - min(y)) / min(y) AS difference FROM {STATUSES}""")
def bar_facts_series(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    return K.bar_facts(rows, "o_orderpriority", "amount", series="o_orderstatus").drop("total", "all_equal")


LINE = """SELECT count(*) AS points, {from_x} AS from_x, {from_v} AS from_value, {to_x} AS to_x, {to_v} AS to_value,
    {change} AS change, arg_max(x, y) AS peak_x, max(y) AS peak_value, {sp} AS start_partial, {ep} AS end_partial, {il} AS incomplete_last FROM {series}"""


def _line_sql(to_n: int, ep: str, il: str) -> str:
    at = f"(SELECT {{c}} FROM {MONTHLY} ORDER BY x DESC LIMIT 1 OFFSET {to_n})"
    first, to_x, to_v = "arg_min(y, x)", at.format(c="x"), at.format(c="y")
    return LINE.format(
        from_x="min(x)", from_v=first, to_x=to_x, to_v=to_v, change=f"({to_v} - {first}) / abs({first})", sp="false", ep=ep, il=il, series=MONTHLY
    )


@query("line_facts", _line_sql(1, "false", "true"))
def line_facts(t: Tables) -> DataFrame:
    """The last month holds a single day, so the comparison ends one month earlier."""
    return K.line_facts(monthly(t), "x", "y")


@query("line_facts_complete", _line_sql(1, "true", "false"))
def line_facts_complete(t: Tables) -> DataFrame:
    """The same with the date range of the data, which says that the last month is partial."""
    days = t.orders.agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("b")).first()
    return K.line_facts(monthly(t), "x", "y", coverage=(days["a"], days["b"]))


@query("line_facts_cumulative", f"""
    SELECT count(*) AS points, min(x) AS from_x, max(x) AS to_x, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) AS to_value, CAST(NULL AS DOUBLE) AS change FROM {MONTHLY}""")
def line_facts_cumulative(t: Tables) -> DataFrame:
    series = Q.cumulative(monthly(t).withColumn("y", F.col("y").cast("decimal(18,2)")), "x", "y")
    return K.line_facts(series, "x", "cumulative", cumulative=True).select("points", "from_x", "to_x", "to_value", "change")


@query("line_facts_cumulative_covered", f"""
    SELECT count(*) AS points, max(x) AS to_x, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) AS to_value, true AS end_partial FROM {MONTHLY}""")
def line_facts_cumulative_covered(t: Tables) -> DataFrame:
    """A running total with data up to the 2nd of the last month still reports its last value."""
    series = Q.cumulative(monthly(t).withColumn("y", F.col("y").cast("decimal(18,2)")), "x", "y")
    ends = series.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    return K.line_facts(series, "x", "cumulative", cumulative=True, coverage=(f"{ends['a']}-01", f"{ends['b']}-02")).select("points", "to_x", "to_value", "end_partial")


@query("incomplete_last", f"""
    SELECT arg_max(y, x) < 0.25 * (SELECT median(y) FROM {MONTHLY} WHERE x < (SELECT max(x) FROM {MONTHLY})) AS incomplete FROM {MONTHLY}""")
def incomplete_last(t: Tables) -> DataFrame:
    return K.line_facts(monthly(t), "x", "y").select(F.col("incomplete_last").alias("incomplete"))


@query("series_leader", f"""
    SELECT x, series AS leader, y AS value FROM {YEARLY} WHERE x = (SELECT max(x) FROM {YEARLY}) ORDER BY y DESC, series LIMIT 1""")
def series_leader(t: Tables) -> DataFrame:
    return K.series_leader(yearly(t), "x", "series", "y")


@query("table_facts", """
    SELECT count(*) AS rows, count(*) > 500 AS truncated, false AS partial, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders""")
def table_facts(t: Tables) -> DataFrame:
    facts = K.table_facts(t.orders, ["o_totalprice"])
    return facts.select("rows", "truncated", "partial", F.round(facts["totals"]["o_totalprice"], 2).alias("total"))
