"""Shaping, takeaways, strictness, quantiles, metering and exports on small inputs."""

import datetime as dt
import math
import random
import time
from collections import deque
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions.text import natural_key
from tallyfold.operators import facts as K
from tallyfold.operators import joins as J
from tallyfold.operators import overview as O
from tallyfold.operators import profile as P
from tallyfold.operators import quantiles as Z
from tallyfold.operators import query as Q
from tallyfold.operators import shape as S
from tallyfold.plans import catalog
from tallyfold.sources import export as E
from tallyfold.sources import workbook as W
from tallyfold.streaming import live as L
from tallyfold.streaming import metering as M
from tools.compare import difference


def test_series_pivot(spark):
    """The series with the larger sum stands first; a missing point is null."""
    df = spark.createDataFrame([("q1", "rail", 3.0), ("q1", "road", 8.0), ("q2", "road", 6.5), ("q3", "rail", 1.0)], "x string, s string, y double")
    out = S.series_pivot(df, "x", "s", "y")
    assert [f.metadata["comment"] for f in out.schema.fields[1:]] == ["road", "rail"]
    assert [tuple(r) for r in out.collect()] == [("q1", 8.0, 3.0), ("q2", 6.5, None), ("q3", None, 1.0)]
    many = spark.range(12).select(F.lit("q").alias("x"), F.col("id").cast("string").alias("s"), F.lit(2.0).alias("y"))
    with pytest.raises(S.TooManySeries):
        S.series_pivot(many, "x", "s", "y")


def test_fold_other(spark):
    sizes = [2 ** i for i in range(9)]
    df = spark.createDataFrame([(f"n{i}", v) for i, v in enumerate(sizes)], "k string, v int")
    out = {r["name"]: r["value"] for r in S.fold_other(df, "k", "v").collect()}
    assert len(out) == 7 and out["Diğer"] == sum(sizes[:3]) and sum(out.values()) == sum(sizes)
    assert S.fold_other(df.withColumn("v", F.col("v") - 3), "k", "v").count() == 0
    assert S.fold_other(df.withColumn("k", F.lit("one")), "k", "v").count() == 0


def test_totals_and_views(spark):
    df = spark.range(750).select(F.concat(F.lit("r"), "id").alias("k"), F.lit(0.7).alias("v"))
    assert S.table_totals(df, ["v"]).first()["total"] == 525.0
    assert S.table_totals(df.limit(1), ["v"]).count() == 0 and S.table_totals(df, ["v"], complete=False).count() == 0
    days = spark.range(S.MAX_LINE_POINTS + 1).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("x"), F.col("id").cast("double").alias("y"))
    flags = S.valid_views(days).first()
    assert not flags["line"] and flags["default_view"] == "table"
    assert S.valid_views(df, ["v"], partial=True).first()["default_view"] == "table"


def test_product_in_any_order(spark, tmp_path):
    """The catalogue's product does not depend on the order of the rows."""
    lines = spark.range(4_000).select(
        F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit(2.0).alias("l_quantity"), F.lit(7.0).alias("l_extendedprice"),
        F.when(F.col("id") % 401 == 0, None).otherwise(F.col("id") % 11 * 17.0).alias("l_discount"))
    grown = []
    for turn in range(4):
        folder = tmp_path / str(turn)
        lines.orderBy(F.xxhash64(F.lit(turn), "l_discount"), F.rand(turn)).coalesce(1).write.parquet(str(folder / "lineitem.parquet"))
        grown.append(catalog.QUERIES["agg_catalog"](spark, str(folder)).first()["growth"])
    rows = [r["l_discount"] for r in lines.collect() if r["l_discount"] is not None]
    exact = math.prod((Fraction(1 + d / 10000) for d in rows), start=Fraction(1))
    assert len(set(grown)) == 1 and grown[0] == pytest.approx(float(exact), rel=1e-14)


def _beside_sql(spark, folder, name, tables):
    """The difference of a query from its SQL on small tables; DuckDB reads them in one thread, that is in their order."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=1")
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return difference(catalog.QUERIES[name](spark, str(folder)), con, catalog.ORACLES[name])[0]


def test_catalog_ties_and_nulls(spark, tmp_path):
    """Rows at one price have the quantity of the first of them; empty cells count as in SQL."""
    nan = float("nan")
    lines = [("A", "O", 9.0, 70.5, 0.02), ("A", None, 4.0, 70.5, 0.03), ("A", "F", 2.0, 1.25, None), ("A", "F", 31.0, 1.25, 0.1), ("A", "O", None, 88.0, 0.04),
             ("A", "O", None, 0.5, 0.04), ("A", "F", 6.0, None, 0.07), ("B", None, 3.0, 12.0, None), ("C", "F", 8.0, nan, 0.01), ("C", "F", 5.0, 2.0, 0.01),
             ("D", "O", None, 3.0, 0.06), (None, "O", 1.0, 3.0, 0.05)]
    lines = spark.createDataFrame(lines, "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double")
    assert _beside_sql(spark, tmp_path, "agg_catalog", {"lineitem": lines}) is None
    assert catalog.QUERIES["agg_catalog"](spark, str(tmp_path)).columns[11:14] == ["var_pop", "growth", "q90_cont"]


def test_plain_number_of_zero(spark, tmp_path):
    events = spark.createDataFrame([(0, 0.0), (1, 0.01), (2, 40.0), (3, 123456.78), (4, None), (5, -0.0)], "event_id long, value double")
    assert _beside_sql(spark, tmp_path, "plain_number", {"events": events}) is None
    cells = spark.createDataFrame([("0E-11",), ("0e0",)], "t string").select(W.plain_number(F.col("t")))
    assert [r[0] for r in cells.collect()] == ["0", "0"]


def months(values, year=2018):
    return [(f"{year}-{i + 1:02d}", float(v)) for i, v in enumerate(values)]


def test_line_facts_with_coverage(spark):
    df = spark.createDataFrame(months([80, 90, 60, 100, 40]), "x string, y double")
    cut = K.line_facts(df, "x", "y", coverage=("2018-01-01", "2018-05-11")).first()
    assert (cut["from_x"], cut["to_x"], cut["change"], cut["end_partial"], cut["peak_x"]) == ("2018-01", "2018-04", 0.25, True, "2018-04")
    both = K.line_facts(df, "x", "y", coverage=("2018-01-09", "2018-05-11")).first()
    assert (both["from_x"], both["start_partial"]) == ("2018-02", True)
    whole = K.line_facts(df, "x", "y", coverage=("2018-01-01", "2018-05-31")).first()
    assert whole["to_x"] == "2018-05" and whole["change"] == -0.5 and not whole["end_partial"]
    fallen = K.line_facts(spark.createDataFrame(months([40, 44, 50, 1]), "x string, y double"), "x", "y").first()
    assert fallen["incomplete_last"] and fallen["to_x"] == "2018-03" and math.isclose(fallen["change"], 0.25)
    flat = spark.createDataFrame(months([0, 7]), "x string, y double")
    assert K.line_facts(flat, "x", "y").first()["change"] is None
    assert K.line_facts(flat.limit(1), "x", "y").first()["points"] == 1 and K.line_facts(flat.filter("false"), "x", "y").count() == 0


def test_running_total_reports_its_last_value(spark):
    df = spark.createDataFrame(months([5, 9, 14]), "x string, y double")
    got = K.line_facts(df, "x", "y", cumulative=True, coverage=("2018-01-01", "2018-03-08")).first()
    assert (got["to_x"], got["to_value"], got["end_partial"], got["change"]) == ("2018-03", 14.0, True, None)


def test_lines_of_any_length_have_facts(spark):
    df = spark.range(5000).select(F.format_string("p%05d", "id").alias("x"), (500 + F.col("id") % 977).cast("double").alias("y"))
    got = K.line_facts(df, "x", "y").first()
    assert (got["points"], got["from_x"], got["to_x"], got["peak_x"], got["peak_value"]) == (5000, "p00000", "p04999", "p00976", 1476.0)


def test_wide_tables_are_profiled_whole(spark):
    wide = spark.range(3).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(120)], F.lit("2018-04-05").cast("date").alias("day"))
    assert P.filled(wide).count() == 121 and P.coverage(wide).count() == 1
    assert P.top_values(wide).select("column").distinct().count() == 120


def test_bar_facts(spark):
    df = spark.createDataFrame([("Ordu", 30.0), ("Gediz", 48.0), ("Foça", 36.0)], "k string, v double")
    f = K.bar_facts(df, "k", "v").first()
    assert (f["max_x"], f["min_x"], f["difference"], f["total"]) == ("Gediz", "Ordu", 0.6, None)
    assert K.bar_facts(df.withColumn("v", F.col("v") - 30), "k", "v").first()["difference"] is None


def test_precise_and_strict_sums(spark):
    def total(*values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(Q.precise_sum(F.col("v"))).first()[0]

    assert spark.range(7_000).select(F.lit(0.3).alias("v")).agg(Q.precise_sum(F.col("v"))).first()[0] == 2100.0
    assert total(4e15, 0.25, -4e15) == 0.25 and total(3e18, 2.0, -3e18) == 2.0 and total(1e30, 2.0, -1e30) == 2.0
    assert total(1e30) == 1e30 and total(None) is None and math.isnan(total(1.0, math.nan)) and total(5.0, math.inf) == math.inf
    mixed = spark.createDataFrame([("8.25",), ("eight",)], "v string")
    with pytest.raises(Exception, match="not a number"):
        mixed.agg(F.sum(Q.strict_number(F.col("v")))).collect()


def test_natural_order(spark):
    names = ["ek 10", "ek 9", "ek 009", "çam 2", "cam 30", "ılgın", "ilgi", "ek " + "8" * 22, "ek " + "9" * 21, "dal"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["cam 30", "çam 2", "dal", "ek 009", "ek 9", "ek 10", "ek " + "9" * 21, "ek " + "8" * 22, "ılgın", "ilgi"]


def test_stems_match_through_ligatures(spark):
    df = spark.createDataFrame([("Oﬃce ĳs",), ("Of fice",), ("Ofis",)], "t string")
    assert [r[0] for r in df.select(Q.contains_stem(F.col("t"), "oﬃce ĳ")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(Q.contains_stem(F.col("t"), "office")).collect()] == [True, False, False]


def test_refusals(spark):
    sales = spark.createDataFrame([("Ordu", 4)], "depo string, ton int")
    staff = spark.createDataFrame([("Ece", 9)], "isim string, yas int")
    plans = spark.createDataFrame([("Ordu", 30), ("Ordu", 12)], "depo string, hedef_ton int")
    with pytest.raises(J.NoSharedKey):
        J.safe_join(sales, staff)
    row = J.safe_join(sales, plans, None, [F.sum("ton").alias("t")], [F.sum("hedef_ton").alias("h")]).first()
    assert (row["t"], row["h"]) == (4, 42)
    with pytest.raises(Q.MissingColumn):
        Q.require_columns(sales, "raf")
    with pytest.raises(Q.DuplicateColumn):
        Q.project(sales, [("z", F.col("depo")), ("z", F.col("ton"))])


@pytest.mark.parametrize("keep", [50, 1_000_000])
def test_exact_quantiles(spark, keep):
    rng = random.Random(7)
    values = [round(rng.expovariate(0.01), 2) for _ in range(4000)] + [5.0] * 2000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = Z.exact_quantiles(df, "v", [0.25, 0.5, 0.9], keep=keep).first()
    ordered = sorted(values)
    for p, g in zip([0.25, 0.5, 0.9], got):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert math.isclose(g, low + (high - low) * (at - math.floor(at)), rel_tol=1e-12)


@pytest.mark.parametrize("keep", [20, 1_000_000])
def test_grouped_quantiles_and_ranks(spark, keep):
    """A hot group, a group of one value, a null key, ties and missing values, narrowed together."""
    rng = random.Random(8)
    rows = [("hot", round(rng.gauss(0, 50), 1)) for _ in range(4000)] + [("hot", 7.0)] * 1500 + [("one", 3.5)] * 60 + [("few", 1.0), ("few", 2.0), ("few", None)]
    rows += [(None, float(i)) for i in range(100)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in Z.grouped_quantiles(df, ["k"], "v", [0.0, 0.25, 0.9], keep=keep).collect()}
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    assert set(got) == set(held)
    for k, values in held.items():
        values.sort()
        for p, g in zip([0.0, 0.25, 0.9], got[k]):
            at = p * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert math.isclose(g, low + (high - low) * (at - math.floor(at)), rel_tol=1e-12, abs_tol=1e-12)
    ids = df.where("k is not null").select("k", F.xxhash64(F.monotonically_increasing_id()).alias("id"))
    ranks = spark.createDataFrame([("hot", 0), ("hot", 2750), ("hot", 5499), ("hot", 9999), ("one", 59), ("lost", 1)], "k string, rank int")
    listed = {}
    for r in ids.collect():
        listed.setdefault(r["k"], []).append(r["id"])
    want = sorted((k, sorted(listed[k])[n]) for k, n in [("hot", 0), ("hot", 2750), ("hot", 5499), ("one", 59)])
    assert sorted(map(tuple, Z.value_at_rank(ids, ["k"], "id", ranks, keep=keep).collect())) == want


def test_events_are_decided_in_time_order(spark, tmp_path):
    """Events arrive out of order within the delay; one that comes later than the watermark gets no decision and does not count."""
    base = dt.datetime(2025, 1, 1)
    batches = [[(0, 30, 1), (0, 10, 2), (1, 5, 3)], [(0, 20, 4), (0, 15, 5), (1, 200, 6)], [(0, 300, 8)], [(0, 12, 7), (0, 1000, 9), (1, 1000, 10)]]
    stream_of = spark.readStream.schema("k long, ts timestamp, i long").option("maxFilesPerTrigger", 1)
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(k, base + dt.timedelta(seconds=s), i) for k, s, i in rows], "k long, ts timestamp, i long")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={n}"))
        time.sleep(1.1)
    stream = stream_of.parquet(str(tmp_path / "in" / "b=*"))
    got = {(r["k"], r["i"]): r["admitted"] for r in L.drained(L.sliding_limit_in_time(stream, "k", "ts", "i", 2, 60, "100 seconds"), "in-time").collect()}
    # The watermark stood at 100 s in the batch before event 7 (12 s), and stands at 900 s in the end.
    in_time = [e for b in batches for e in b if e[2] != 7 and e[1] < 900]
    assert got == brute_force(in_time, 2, 60)


def test_refused_stretches_are_one_step():
    rng = random.Random(4)
    for limit, window, n in ((1, 50, 300), (3, 2_000_000, 500), (2, 7_000_000, 400)):
        times = sorted(rng.randrange(0, 40_000_000) for _ in range(n))
        a, b = deque([5, 9][:limit]), deque([5, 9][:limit])
        want = [-1 if w is None else w for w in M.admit(times, a, limit, window)]
        assert M.waits_of(np.array(times), b, limit, window).tolist() == want and a == b


def test_slices_are_few_batches_and_buckets_many_keys(spark, tmp_path):
    """Twice as many shuffle partitions make no more files a slice, and keys that share a bucket are decided each by itself."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers = L.in_slices(spark.range(6000), F.col("id") % 3, 3)
        query = numbers.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [2000] * 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rng, base = random.Random(9), dt.datetime(2025, 1, 1)
    events = [(rng.choice("abcdefg"), rng.randrange(0, 400), i) for i in range(300)] + [("z", 1000, 300)]
    df = spark.createDataFrame([(k, base + dt.timedelta(seconds=s), i) for k, s, i in events], "k string, ts timestamp, i long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r["k"], r["i"]): r["admitted"] for r in L.drained(L.sliding_limit_in_time(stream, "k", "ts", "i", 2, 60, "10 seconds", buckets=2), "in-time").collect()}
    assert got == brute_force(events[:-1], 2, 60)


def test_warnings_are_numbered_on(spark):
    rows = [(("kuzey", "güney", "doğu")[i % 3], 40 + i * 7 % 13) for i in range(300)] + [("doğu", 9_000)]
    found = O.overview(spark.createDataFrame(rows, "depo string, tutar int")).collect()
    assert [r["seq"] for r in found] == list(range(len(found))) and {"outliers", "duplicates"} <= {r["kind"] for r in found}


def test_outliers_and_text_only(spark):
    rows = [(("kuzey", "güney", "doğu")[i % 3], 40 + i * 7 % 13) for i in range(300)] + [("doğu", 9_000), ("kuzey", -6)]
    df = spark.createDataFrame(rows, "depo string, tutar int")
    found = {r["kind"]: r for r in O.overview(df).collect()}
    assert found["outliers"]["rows"] == 1 and found["outliers"]["amount"] == 9_000
    assert found["negatives"]["rows"] == 1 and "top" not in found
    text = spark.createDataFrame([("raf", "pul"), ("raf", "vida"), ("kasa", "vida"), ("raf", "çivi")], "yer string, kalem string")
    rows = O.overview(text).collect()
    assert rows[0]["kind"] == "total" and rows[0]["rows"] == 4 and rows[0]["subject"] is None
    assert rows[1]["value"] == "raf" and rows[1]["amount"] == 3


def test_month_spike(spark):
    months = [(f"2025-{m:02d}", 100.0 + m, 1, 28) for m in range(1, 9)] + [("2025-09", 900.0, 1, 30), ("2025-10", 5000.0, 1, 2)]
    df = spark.createDataFrame(months, "month string, amount double, lo int, hi int")
    got = [tuple(r)[:2] for r in O.month_spikes(df).collect()]
    assert got == [("2025-09", 900.0)]


def brute_force(events, limit, window):
    admitted, out = {}, {}
    for key, t, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        recent = [a for a in admitted.get(key, []) if a > t - window]
        out[(key, i)] = len(recent) < limit
        admitted[key] = recent + [t] * out[(key, i)]
    return out


@pytest.mark.parametrize("slice_seconds", [60, 1000])
def test_sliding_limit_against_brute_force(spark, slice_seconds):
    """Short slices of a busy key never forget their entry, so the key is decided as one stream."""
    rng = random.Random(3)
    base = dt.datetime(2025, 1, 1)
    events = [(rng.choice("aaaab"), rng.randrange(0, 4000), i) for i in range(800)]
    df = spark.createDataFrame([(k, base + dt.timedelta(seconds=s), i) for k, s, i in events], "k string, ts timestamp, i bigint")
    got = {(r["k"], r["i"]): r["admitted"] for r in M.sliding_limit(df, "k", "ts", "i", 3, 60, slice_seconds=slice_seconds).collect()}
    assert got == brute_force(events, 3, 60)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("+SUM(B1)", 80412.3456, -7.25), ("x;y", 3.0, None), ("büyük", 1e40, 0.5)], "t string, m double, n double")
    rows = [tuple(r) for r in E.export_format(df, {"m": "currency"}).collect()]
    assert rows == [("'+SUM(B1)", "80412,35", "-7,25"), ("x;y", "3", None), ("büyük", "1,0E40", "0,5")]
    E.export_csv(df.limit(2).coalesce(1), str(tmp_path / "out"), {"m": "currency"}, {"t": "Not", "m": "Bedel", "n": "Fark"})
    text = next((tmp_path / "out").glob("*.csv")).read_bytes().decode("utf-8")
    assert text == "\ufeffNot;Bedel;Fark\r\n'+SUM(B1);80412,35;-7,25\r\n\"x;y\";3;\r\n"
    E.export_typed(spark.createDataFrame([("2018-04-05", 1)], "d string, n int"), str(tmp_path / "typed"), {"d": "date"})
    assert dict(spark.read.parquet(str(tmp_path / "typed")).dtypes) == {"d": "timestamp_ntz", "n": "int"}
    first = E.bounded_fetch(spark.range(50), F.desc("id"), limit=3).collect()
    assert [(r["id"], r["partial"]) for r in first] == [(49, True), (48, True), (47, True)]


def test_page_rows(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = S.page_rows(df, [F.desc("v"), "id"], 25).collect()
    want = sorted([(-(i % 7), i) for i in range(60)])
    assert {r["id"]: (r["row_no"], r["page"]) for r in got} == {i: (n + 1, n // 25) for n, (_, i) in enumerate(want)}


def test_views_and_bars_with_a_series(spark):
    """Two dimensions: eight labels are drawn, nine are not; a pair that occurs twice and a series equal to x."""
    def result(labels):
        return spark.createDataFrame([(f"x{x}", f"l{s:02d}" if s else None, float(x + s)) for x in range(3) for s in range(labels)], "x string, label string, v double")

    def views(df, **axes):
        return {k for k, on in S.valid_views(df, ["v"], **axes).first().asDict().items() if on is True}

    assert views(result(8), x="x", series="label") == {"bar", "table"}
    assert views(result(9), x="x", series="label") == {"table"}
    assert views(result(1), x="x", series="label") == {"bar", "pie", "table"}
    assert views(result(2).unionByName(result(1)), x="x", series="label") == {"table"}
    assert views(result(2)) == {"table"} and views(result(2), x="x", series="x") == {"table"}
    assert views(result(0), x="x", series="label") == set()
    bars = K.bar_facts(result(3), "x", "v", series="label").first()
    assert (bars["max_x"], bars["max_series"], bars["min_x"], bars["min_series"], bars["points"]) == ("x2", "l02", "x0", S.NO_LABEL, 9)
    assert K.bar_facts(result(0), "x", "v", series="label").count() == 0
