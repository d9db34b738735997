"""Column profiles of the orders and part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import profile as P
from tallyfold.plans.registry import Tables, query

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _each(expression: str, columns: list[str] = ORDER_COLUMNS) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expression.format(c=c)} FROM orders" for c in columns)


@query("profile_filled", _each("count({c}) AS filled"))
def profile_filled(t: Tables) -> DataFrame:
    return P.filled(t.orders)


@query("profile_distinct", _each("count(DISTINCT {c}) AS \"distinct\""))
def profile_distinct(t: Tables) -> DataFrame:
    return P.distinct(t.orders, exact=True)


# Three times the standard error that the sketch is made for.
SKETCH_BOUND = 0.15


@query("profile_distinct_approx", _each("count(DISTINCT {c}) AS \"distinct\", true AS within"))
def profile_distinct_approx(t: Tables) -> DataFrame:
    """The sketch's counts beside the exact ones."""
    guess = P.distinct(t.orders).withColumnRenamed("distinct", "guess")
    exact = P.distinct(t.orders, exact=True)
    return exact.join(guess, "column").select("column", "distinct", (F.abs(F.col("guess") - F.col("distinct")) <= SKETCH_BOUND * F.col("distinct") + 1).alias("within"))


def _range_sql() -> str:
    numbers = ["o_orderkey", "o_custkey", "o_totalprice"]
    parts = []
    for c in ORDER_COLUMNS:
        number = f"CAST(min({c}) AS DOUBLE) AS min_number, CAST(max({c}) AS DOUBLE) AS max_number" if c in numbers else "NULL AS min_number, NULL AS max_number"
        date = f"strftime(min({c}), '%Y-%m-%d %H:%M') AS min_date, strftime(max({c}), '%Y-%m-%d %H:%M') AS max_date" if c == "o_orderdate" else "NULL AS min_date, NULL AS max_date"
        source = "orders" if c in numbers or c == "o_orderdate" else "(SELECT 1)"
        parts.append(f"SELECT '{c}' AS \"column\", {number}, {date} FROM {source}")
    return " UNION ALL ".join(parts)


@query("profile_range", _range_sql())
def profile_range(t: Tables) -> DataFrame:
    return P.value_range(t.orders)


@query("profile_top_values", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, count(*) AS count
        FROM part GROUP BY {c}) WHERE rank <= 3""" for c in ["p_name", "p_brand", "p_type"]))
def profile_top_values(t: Tables) -> DataFrame:
    return P.top_values(t.part)


@query("coverage", """
    SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M') AS "from", strftime(max(o_orderdate), '%Y-%m-%d %H:%M') AS "to" FROM orders""")
def coverage(t: Tables) -> DataFrame:
    return P.coverage(t.orders)


def _table_sql() -> str:
    kinds = {"o_orderkey": "number", "o_custkey": "number", "o_totalprice": "number", "o_orderdate": "date", "o_orderstatus": "text", "o_orderpriority": "text"}
    parts = []
    for c, kind in kinds.items():
        bound = {"number": "CAST(CAST({f}({c}) AS DOUBLE) AS VARCHAR)", "date": "strftime({f}({c}), '%Y-%m-%d %H:%M')", "text": "CAST(NULL AS VARCHAR)"}[kind]
        top = f"""(SELECT '[' || string_agg('{{"value":"' || v || '","count":' || n || '}}', ',' ORDER BY n DESC, v) || ']'
            FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3))""" if kind == "text" else "CAST(NULL AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS type, count({c}) AS filled, {bound.format(f='min', c=c)} AS min, {bound.format(f='max', c=c)} AS max, {top} AS top, true AS within FROM orders""")
    return " UNION ALL ".join(parts)


@query("profile_table", _table_sql())
def profile_table(t: Tables) -> DataFrame:
    """The whole profile; its distinct counts come from a sketch and are held against the exact ones."""
    exact = P.distinct(t.orders, exact=True).withColumnRenamed("distinct", "exact")
    made = P.profile_table(t.orders).join(exact, "column")
    near = F.abs(F.col("distinct") - F.col("exact")) <= SKETCH_BOUND * F.col("exact") + 1
    return made.select("column", "type", "filled", "min", "max", F.to_json("top").alias("top"), near.alias("within"))
