"""Type recovery on the columns every messy export has."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions import values as V
from tallyfold.operators import recover as R

D, DT = dt.date, dt.datetime


def local(cents: int) -> str:
    """As money is written with a decimal comma."""
    return f"{cents / 100:,.2f}".replace(",", "_").replace(".", ",").replace("_", ".")


AMOUNTS = [731_905, 1_284_066, 50, 987_654_321, 19]
DAYS = [D(2019, 3, 27), D(2021, 11, 30), D(1998, 6, 14)]
MONTHS = {"tr": ["Mart", "Kasım", "Haziran"], "en": ["March", "November", "June"]}


def written(pattern: str) -> list[str]:
    return [d.strftime(pattern) for d in DAYS]


# name, cells, kind, converted values (None: not compared), flags. The cells follow from a rule: a shape, a sign, a scale or an ambiguity.
CASES = [
    ("local_money", [f"{local(c)} TL" for c in AMOUNTS], "tr-number", [c / 100 for c in AMOUNTS], {}),
    ("local_signs", [f"({local(AMOUNTS[0])})", f"{local(AMOUNTS[1])}-", f"−{local(AMOUNTS[2])}", local(AMOUNTS[3])], "tr-number",
     [-AMOUNTS[0] / 100, -AMOUNTS[1] / 100, -AMOUNTS[2] / 100, AMOUNTS[3] / 100], {}),
    ("one_broken", [local(c) for c in AMOUNTS] + ["88:31)07"], "text", None, {"unreadable": 1}),
    ("places", ["Gediz", "Foça", "17", "Havza", "Ordu"], "text", None, {"unreadable": 0}),
    ("one_comma_each", [f"{n},{n * 37 % 1000:03d}" for n in (4, 9, 21)], "text", None, {"ambiguous": True}),
    ("comma_decides_decimal", ["4,148", "9,3", "21,77"], "tr-number", [4.148, 9.3, 21.77], {}),
    ("comma_decides_thousand", ["4,148", "9,333,777"], "us-thousands", [4148, 9333777], {}),
    ("point_money", [f"${c / 100:,.2f}" for c in AMOUNTS[:2]] + ["63"], "us-thousands", [7319.05, 12840.66, 63], {"currency_stripped": True}),
    ("point_thousand", ["4.148", "9.333", "21.777"], "tr-number", [4148, 9333, 21777], {}),
    ("point_decimal", ["4.1", "9.333", "0.5", "21"], "decimal", [4.1, 9.333, 0.5, 21], {}),
    ("like_years", ["1987.25", "2011.5", "2030.75"], "decimal", [1987.25, 2011.5, 2030.75], {}),
    ("too_long", ["7" * 22, "3" * 21], "text", None, {}),
    ("failed_formulas", ["#DIV/0!", "41", "#SAYI/0!"], "integer", [None, 41, None], {}),
    ("leading_zeros", ["0071", "0452", "9"], "text", ["0071", "0452", "9"], {}),
    ("gaps", [local(AMOUNTS[0]), "-", "", None, "N/A"], "tr-number", [AMOUNTS[0] / 100, None, None, None, None], {}),
    ("nothing", ["-", None, ""], "text", [None, None, None], {}),
    ("spaces", ["  Gediz", "Foça  "], "text", ["Gediz", "Foça"], {}),
    ("half_words", [local(AMOUNTS[0]), "hiç değil"], "text", [local(AMOUNTS[0]), "hiç değil"], {}),
    ("day_first", written("%d.%m.%Y") + ["9/4/2020"], "dmy-date", [*DAYS, D(2020, 4, 9)], {}),
    ("month_first", written("%m/%d/%Y"), "mdy-date", DAYS, {}),
    ("year_first", [DAYS[0].strftime("%Y-%m-%d"), DAYS[1].strftime("%Y/%m/%d"), DAYS[2].strftime("%Y.%m.%d")], "iso-date", DAYS, {}),
    ("short_years", written("%d.%m.%y"), "dmy-date", DAYS, {}),
    ("months_only", written("%Y-%m"), "iso-date", [d.replace(day=1) for d in DAYS], {}),
    ("month_names", [f"{d.day} {m} {d.year}" for d, m in zip(DAYS, MONTHS["tr"])] + [f"{m} {d.day}, {d.year}" for d, m in zip(DAYS, MONTHS["en"])],
     "dmy-date", [*DAYS, *DAYS], {}),
    ("no_such_day", [written("%d.%m.%Y")[0], "30.02.2019"], "text", [written("%d.%m.%Y")[0], "30.02.2019"], {}),
    ("not_dates", ["3.4.1", "3.12.0", "4.0.7"], "text", None, {}),
    ("zones", ["2019-03-27T22:15:40Z", "2021-11-30T06:00:00-05:00"], "iso-date", [DT(2019, 3, 27, 22, 15, 40), DT(2021, 11, 30, 6)], {}),
    ("clocks", ["27.03.2019 22:15:40", "30.11.2021 7:45 PM", "14.06.1998 10:10 am"], "dmy-date", [DT(2019, 3, 27, 22, 15, 40), DT(2021, 11, 30, 19, 45), DT(1998, 6, 14, 10, 10)], {}),
    ("midnights", [f"{x} 00:00:00" for x in written("%Y-%m-%d")], "iso-date", DAYS, {}),
]


@pytest.fixture(scope="module")
def decisions(spark):
    cells = [(name, v) for name, vs, *_ in CASES for v in vs]
    df = spark.createDataFrame(cells, "file string, value string")
    rows = R.decide(R.profile_text(df, ["value"], ["file"])).collect()
    return {r["file"]: r for r in rows}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_decisions(decisions, case):
    name, _, kind, _, flags = case
    row = decisions[name]
    assert row["kind"] == kind
    for flag, expected in flags.items():
        assert row[flag] == expected


def test_conversion(spark, decisions):
    for name, values, _, expected, _ in CASES:
        if expected is None:
            continue
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
        d = decisions[name]
        out = R.convert(df, [R.Decision(name, d["kind"], d["scale"], d["with_time"])]).orderBy("i").collect()
        got = [r[name] for r in out]
        got = [float(g) if isinstance(g, Decimal) else g for g in got]
        assert got == expected, name


def test_total_of_local_money_is_exact(spark):
    """Cents that no double holds, summed over many rows."""
    step = 37
    cents = F.col("id") * step + 7
    whole, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    df = spark.range(40_000).select(F.concat(whole, F.lit(","), rest, F.lit(" ₺")).alias("money"))
    total = R.clean_table(df).agg(F.sum("money").alias("s")).first()["s"]
    assert total == Decimal(sum(i * step + 7 for i in range(40_000))) / 100


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=30))
def test_local_number_round_trip(spark, cents):
    texts = [f"{c / 100:,.2f}".replace(",", "_").replace(".", ",").replace("_", ".") for c in cents]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", V.read_comma_decimal(V.money_text(F.col("t")), 2).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in out] == [Decimal(c) / 100 for c in cents]


def test_folder_is_decided_in_one_job(spark):
    df = spark.createDataFrame([("p", local(AMOUNTS[0])), ("p", local(AMOUNTS[2])), ("q", "2019-03-27"), ("q", "2021-11-30")], "file string, v string")
    got = {r["file"]: r["kind"] for r in R.cleaning_report(df, ["v"], ["file"]).collect()}
    assert got == {"p": "tr-number", "q": "iso-date"}
