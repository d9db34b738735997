"""Questions over two tables: targets, winners and sets.

A supplier's account balance plays the target: every nation has several, so joining raw rows would
multiply totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import joins as J
from tallyfold.operators import query as Q
from tallyfold.plans.questions import NET, ORDER_PRICE, cents, net, total
from tallyfold.plans.registry import Tables, query


def sales(t: Tables) -> DataFrame:
    """Customer balances with their nation's name."""
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return t.customer.join(nation, "c_nationkey").select("nation", "c_custkey", cents("c_acctbal").alias("amount"))


def targets(t: Tables) -> DataFrame:
    """Several targets per nation; the name is spelt differently and some nations have none."""
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    kept = t.supplier.filter(F.col("s_nationkey") % 5 != 0).join(nation, "s_nationkey")
    return kept.select("nation", "s_suppkey", (cents("s_acctbal") * 14).alias("target"))


SALES = "(SELECT n_name AS nation, c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS amount FROM customer JOIN nation ON c_nationkey = n_nationkey)"
TARGETS = "(SELECT n_name AS nation, s_suppkey, CAST(s_acctbal AS DECIMAL(18,2)) * 14 AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 5 <> 0)"
BOTH = f"""(SELECT s.nation, CAST(s.actual AS DOUBLE) AS actual, CAST(h.target AS DOUBLE) AS target
    FROM (SELECT nation, sum(amount) AS actual FROM {SALES} GROUP BY 1) s
    LEFT JOIN (SELECT nation, sum(target) AS target FROM {TARGETS} GROUP BY 1) h USING (nation))"""


def joined(t: Tables, how: str = "left") -> DataFrame:
    return J.safe_join(sales(t), targets(t), None, [total(F.col("amount")).alias("actual")], [total(F.col("target")).alias("target")], how)


@query("safe_join", f"SELECT nation, actual, target FROM {BOTH}")
def safe_join(t: Tables) -> DataFrame:
    return joined(t)


@query("fanout_trap", f"""
    SELECT nation, CAST(sum(amount) AS DOUBLE) AS inflated_total, count(*) AS joined_rows
    FROM {SALES} s JOIN {TARGETS} h USING (nation) GROUP BY 1""")
def fanout_trap(t: Tables) -> DataFrame:
    """The wrong total that a join of the raw rows gives, derived without producing those rows."""
    trap = J.fanout(sales(t), targets(t), "nation", F.col("amount"))
    return trap.select("nation", F.col("inflated_total").cast("double"), "joined_rows")


@query("join_key_spelling", f"""
    SELECT upper(s.nation) AS nation, CAST(s.actual AS DOUBLE) AS actual, h.suppliers
    FROM (SELECT nation, sum(amount) AS actual FROM {SALES} GROUP BY 1) s
    JOIN (SELECT nation, count(*) AS suppliers FROM {TARGETS} GROUP BY 1) h USING (nation)""")
def join_key_spelling(t: Tables) -> DataFrame:
    """The key is padded and lower-cased on one side."""
    messy = targets(t).withColumn("nation", F.concat(F.lit(" "), F.lower("nation"), F.lit("  ")))
    pair = (Q.match_key(F.col("nation")), Q.match_key(F.col("nation")))
    out = J.safe_join(sales(t), messy, pair, [total(F.col("amount")).alias("actual")], [F.count("*").alias("suppliers")], "inner", "nation")
    return out.withColumn("nation", F.upper("nation"))


@query("join_month_key", f"""
    SELECT o.period, CAST(o.amount AS DOUBLE) AS amount, CAST(l.units AS DOUBLE) AS units
    FROM (SELECT strftime(o_orderdate, '%Y-%m') AS period, sum({ORDER_PRICE}) AS amount FROM orders GROUP BY 1) o
    LEFT JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS period, sum(l_quantity) AS units FROM lineitem GROUP BY 1) l USING (period)""")
def join_month_key(t: Tables) -> DataFrame:
    """A date on one side and year-month text on the other meet as text."""
    plan = t.lineitem.select(Q.period_text(F.col("l_shipdate"), "month").alias("month_text"), "l_quantity")
    pair = (Q.period_text(F.col("o_orderdate"), "month"), F.col("month_text"))
    return J.safe_join(t.orders, plan, pair, [total(cents("o_totalprice")).alias("amount")], [F.sum("l_quantity").alias("units")], "left", "period")


@query("attainment", f"""
    SELECT nation, actual, target, 100.0::DOUBLE * actual / nullif(target, 0) AS attainment FROM {BOTH}""")
def attainment(t: Tables) -> DataFrame:
    return J.attainment(joined(t), "actual", "target")


@query("met_target", f"""
    SELECT nation, actual, target, 100.0::DOUBLE * actual / nullif(target, 0) AS attainment FROM {BOTH} WHERE actual >= target""")
def met_target(t: Tables) -> DataFrame:
    return J.attainment(J.met_target(joined(t, "inner"), "actual", "target"), "actual", "target")


@query("missed_target", f"SELECT nation, actual, target FROM {BOTH} WHERE actual < target")
def missed_target(t: Tables) -> DataFrame:
    return J.met_target(joined(t, "inner"), "actual", "target", met=False)


@query("anti_join", """
    SELECT DISTINCT l_partkey FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1998-03'
    AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1998-01')""")
def anti_join(t: Tables) -> DataFrame:
    """Sold in March but never in January."""
    def within(start: str, end: str):
        return (F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))

    return J.in_first_not_second(t.lineitem, "l_partkey", within("1998-03-01", "1998-04-01"), within("1998-01-01", "1998-02-01"))


LATEST = "date_trunc('month', l_shipdate) = (SELECT max(date_trunc('month', l_shipdate)) FROM lineitem)"
PREVIOUS = "date_trunc('month', l_shipdate) = (SELECT max(date_trunc('month', l_shipdate)) FROM lineitem) - INTERVAL 1 MONTH"


@query("followup_semi", f"""
    WITH k AS (SELECT l_partkey FROM lineitem WHERE {LATEST} GROUP BY 1 ORDER BY sum({NET}) DESC, l_partkey LIMIT 3)
    SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS units, CAST(sum({NET}) AS DOUBLE) AS revenue
    FROM lineitem WHERE {LATEST} AND l_partkey IN (SELECT l_partkey FROM k) GROUP BY 1""")
def followup_semi(t: Tables) -> DataFrame:
    """``and how many were sold?``: the same three items, another measure."""
    latest = Q.latest_period(t.lineitem, "l_shipdate", "month")
    top = Q.top_n(latest.groupBy("l_partkey").agg(F.sum(net()).alias("revenue")), "revenue", ["l_partkey"], 3)
    return J.same_items(latest, top, "l_partkey").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("units"), total(net()).alias("revenue")
    )


@query("followup_previous", f"""
    WITH k AS (SELECT l_partkey FROM lineitem WHERE {LATEST} GROUP BY 1 ORDER BY sum({NET}) DESC, l_partkey LIMIT 50)
    SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS units
    FROM lineitem WHERE {PREVIOUS} AND l_partkey IN (SELECT l_partkey FROM k) GROUP BY 1""")
def followup_previous(t: Tables) -> DataFrame:
    """``and last month?``: the same items in the period before."""
    latest = Q.latest_period(t.lineitem, "l_shipdate", "month")
    top = Q.top_n(latest.groupBy("l_partkey").agg(F.sum(net()).alias("revenue")), "revenue", ["l_partkey"], 50)
    before = Q.previous_period(t.lineitem, "l_shipdate", "month")
    return J.same_items(before, top, "l_partkey").groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"))


@query("compare_winners", """
    SELECT * FROM (SELECT 'dearest' AS criterion, l_partkey AS item, max(l_extendedprice / l_quantity) AS value FROM lineitem
                   GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'best selling', l_partkey, CAST(sum(l_quantity) AS DOUBLE) FROM lineitem
                   GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)""")
def compare_winners(t: Tables) -> DataFrame:
    """Is the item of the highest price also the best seller?"""
    return Q.extreme_facts(t.lineitem, "l_partkey", [
        ("dearest", F.max(F.col("l_extendedprice") / F.col("l_quantity"))), ("best selling", F.sum("l_quantity")),
    ])
