"""The automatic first look over orders, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import overview as O
from tallyfold.operators import query as Q
from tallyfold.plans.questions import ORDER_PRICE, cents
from tallyfold.plans.registry import Tables, query


def order_book(t: Tables) -> DataFrame:
    """Orders with exact money and the status written as a word."""
    word = F.when(F.col("o_orderstatus") == "F", "Fulfilled").when(F.col("o_orderstatus") == "O", "Open").otherwise("Cancelled by customer")
    return t.orders.select(
        "o_orderkey", word.alias("status"), F.col("o_orderpriority").alias("priority"), cents("o_totalprice").alias("amount"), "o_orderdate",
    )


BOOK = f"""(SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Open' ELSE 'Cancelled by customer' END AS status,
    o_orderpriority AS priority, {ORDER_PRICE} AS amount, o_orderdate FROM orders)"""
BALANCE = "CAST(c_acctbal AS DECIMAL(18,2))"
MONTHS = f"""(SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(amount) AS DOUBLE) AS amount,
    min(day(o_orderdate)) AS lo, max(day(o_orderdate)) AS hi FROM {BOOK} GROUP BY 1)"""
COMPLETE = f"(SELECT * FROM {MONTHS} WHERE lo <= 3 AND hi >= day(last_day(CAST(month || '-01' AS DATE))) - 3)"
SPIKES = f"""(WITH c AS (SELECT month, amount FROM {COMPLETE}),
    m AS (SELECT list_sort(list(amount))[CAST(floor(count(*) / 2) AS INT) + 1] AS med, count(*) AS n FROM c),
    d AS (SELECT list_sort(list(abs(amount - med)))[CAST(floor(count(*) / 2) AS INT) + 1] * 1.4826::DOUBLE AS mad FROM c, m)
    SELECT month, amount, med AS median, amount > med AS high FROM c, m, d WHERE n >= 6 AND mad > 0 AND abs(amount - med) / mad > 3.5)"""


@query("overview_total", f"""
    SELECT count(*) AS rows, CAST(sum({BALANCE}) AS DOUBLE) AS total, count(*) FILTER (c_acctbal < 0) AS negatives,
           count(c_acctbal) AS filled FROM customer""")
def overview_total(t: Tables) -> DataFrame:
    return O.total(t.customer.select(cents("c_acctbal").alias("balance")), "balance")


def _top_sql(dim: str) -> str:
    return f"""SELECT * FROM (SELECT '{dim}' AS dim, {dim} AS value, CAST(sum(amount) AS DOUBLE) AS amount,
        CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM {BOOK}) AS share
        FROM {BOOK} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)"""


@query("overview_top_share", _top_sql("status") + " UNION ALL " + _top_sql("priority"))
def overview_top_share(t: Tables) -> DataFrame:
    return O.top_share(order_book(t), ["status", "priority"], "amount")


@query("monthly_series", f"SELECT * FROM {MONTHS}")
def monthly_series(t: Tables) -> DataFrame:
    return O.monthly_series(order_book(t), "o_orderdate", "amount")


@query("complete_months", f"SELECT * FROM {COMPLETE}")
def complete_months(t: Tables) -> DataFrame:
    return O.complete_months(monthly_series(t))


@query("best_month", f"SELECT month, amount FROM {COMPLETE} ORDER BY amount DESC, month LIMIT 1")
def best_month(t: Tables) -> DataFrame:
    return O.best_month(monthly_series(t))


@query("month_trend", f"""
    SELECT min(month) AS "from", max(month) AS "to", (arg_max(amount, month) - arg_min(amount, month)) / arg_min(amount, month) AS change
    FROM {COMPLETE}""")
def month_trend(t: Tables) -> DataFrame:
    return O.month_trend(monthly_series(t))


@query("month_spikes", f"SELECT * FROM {SPIKES}")
def month_spikes(t: Tables) -> DataFrame:
    return O.month_spikes(monthly_series(t))


@query("status_share", f"""
    SELECT 'status' AS "column", status AS value, count(*) AS rows, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) AS share
    FROM {BOOK} WHERE status = 'Cancelled by customer' GROUP BY 2""")
def status_share(t: Tables) -> DataFrame:
    return O.status_share(order_book(t), ["priority", "status"])


@query("outliers_iqr", """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM events),
    o AS (SELECT count(*) FILTER (value > q3 + 3 * (q3 - q1)) AS count, max(value) FILTER (value > q3 + 3 * (q3 - q1)) AS max,
          count(*) AS n, any_value(med) AS median FROM events, q)
    SELECT count, max, median FROM o WHERE count > 0 AND count <= 0.05 * n""")
def outliers_iqr(t: Tables) -> DataFrame:
    return O.outliers_iqr(t.events, "value")


@query("negatives", """
    SELECT count(*) FILTER (c_acctbal < 0) AS negatives FROM customer
    HAVING count(*) FILTER (c_acctbal < 0) > 0 AND count(*) FILTER (c_acctbal < 0) < 0.5 * count(c_acctbal)""")
def negatives(t: Tables) -> DataFrame:
    row = O.total(t.customer, "c_acctbal")
    return row.filter((F.col("negatives") > 0) & (F.col("negatives") < 0.5 * F.col("filled"))).select("negatives")


@query("duplicate_count", """
    SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicates""")
def duplicate_count(t: Tables) -> DataFrame:
    return O.duplicate_count(t.documents.drop("doc_id"))


@query("duplicate_rows", """
    SELECT text, lang, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1""")
def duplicate_rows(t: Tables) -> DataFrame:
    return O.duplicate_rows(t.documents.select("text", "lang"))


@query("negative_rows", "SELECT * FROM customer WHERE c_acctbal < 0")
def negative_rows(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_acctbal") < 0)


@query("top_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_rows(t: Tables) -> DataFrame:
    return Q.top_n(t.orders, "o_totalprice", ["o_orderkey"], 10)


def _overview_sql() -> str:
    def row(kind: str, subject: str, value: str, amount: str, share: str, rows: str, source: str) -> str:
        return (
            f"SELECT '{kind}' AS kind, {subject} AS subject, {value} AS value, CAST({amount} AS DOUBLE) AS amount, "
            f"CAST({share} AS DOUBLE) AS share, CAST({rows} AS BIGINT) AS rows FROM {source}"
        )

    iqr = f"""(WITH q AS (SELECT quantile_cont(CAST(amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) AS q3 FROM {BOOK}),
        o AS (SELECT count(*) FILTER (amount > q3 + 3 * (q3 - q1)) AS c, max(amount) AS mx, count(*) AS n FROM {BOOK}, q)
        SELECT * FROM o WHERE c > 0 AND c <= 0.05 * n)"""
    return " UNION ALL ".join([
        row("total", "'amount'", "NULL", "sum(amount)", "NULL", "count(*)", BOOK),
        row("top", "dim", "value", "amount", "share", "NULL", f"({_top_sql('status')} UNION ALL {_top_sql('priority')})"),
        row("best_month", "'amount'", "month", "amount", "NULL", "NULL", f"(SELECT month, amount FROM {COMPLETE} ORDER BY amount DESC, month LIMIT 1)"),
        row("trend", "min(month)", "max(month)", "NULL", "(arg_max(amount, month) - arg_min(amount, month)) / arg_min(amount, month)", "NULL", COMPLETE),
        row("status", "'status'", "min(status)", "NULL", "CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders)", "count(*)",
            f"(SELECT * FROM {BOOK} WHERE status = 'Cancelled by customer')"),
        row("month_spike", "'amount'", "month", "amount", "NULL", "NULL", SPIKES),
        row("outliers", "'amount'", "NULL", "mx", "NULL", "c", iqr),
    ])


@query("overview", f"SELECT row_number() OVER () - 1 AS seq, * FROM ({_overview_sql()})")
def overview(t: Tables) -> DataFrame:
    """The whole first look, columns chosen by name and profile."""
    return O.overview(order_book(t))
