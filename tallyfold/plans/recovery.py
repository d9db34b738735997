"""Type recovery over text rendered from the tables: the messy form is derived, the table is the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import text as X
from tallyfold.functions import values as V
from tallyfold.operators import recover as R
from tallyfold.plans.registry import Tables, query

MONTH_WORDS = ["Ocak", "Şubat", "Mart", "NİSAN", "Mayıs", "Haz.", "Temmuz", "AĞUSTOS", "September", "EKİM", "Kasım", "Ara."]


def local_number(c: Column) -> Column:
    """``1234.5`` as ``1.234,50``."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def messy_orders(t: Tables) -> DataFrame:
    """The orders as an export would write them: every column is text."""
    price, date = F.col("o_totalprice"), F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_WORDS]), F.month(date))
    day, year = F.dayofmonth(date).cast("string"), F.year(date).cast("string")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("order_no"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("customer_code"),
        F.concat(local_number(price), F.lit(" TL")).alias("local_money"),
        F.concat(F.lit("$"), F.format_number(price, 2)).alias("us_money"),
        F.translate(F.format_number(price, 2), ",", "").alias("plain_money"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), local_number(price), F.lit(")")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(local_number(price), F.lit("-")))
        .otherwise(F.concat(F.lit("₺ "), local_number(price))).alias("signed_money"),
        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso_day"),
        F.date_format(date, "d.M.yyyy").alias("day_first"),
        F.date_format(date, "M/d/yyyy").alias("month_first"),
        F.concat_ws(" ", day, month, year).alias("named_day"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("N/A")).otherwise(F.concat(F.lit(" "), F.col("o_orderstatus"))).alias("status"),
        F.when(F.col("o_orderkey") % 1000 == 1, F.lit("12:5)")).otherwise(F.col("o_custkey").cast("string")).alias("typo"),
        F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(","), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")).alias("unsure"),
    )


NAMED = "['Ocak','Şubat','Mart','NİSAN','Mayıs','Haz.','Temmuz','AĞUSTOS','September','EKİM','Kasım','Ara.']"
LOCAL = "replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '_'), '.', ','), '_', '.')"
MESSY = f"""(SELECT CAST(o_orderkey AS VARCHAR) AS order_no, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS customer_code,
    {LOCAL} || ' TL' AS local_money, '$' || format('{{:,.2f}}', o_totalprice) AS us_money, format('{{:.2f}}', o_totalprice) AS plain_money,
    CASE o_orderkey % 3 WHEN 0 THEN '(' || {LOCAL} || ')' WHEN 1 THEN {LOCAL} || '-' ELSE '₺ ' || {LOCAL} END AS signed_money,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso_day, strftime(o_orderdate, '%-d.%-m.%Y') AS day_first,
    strftime(o_orderdate, '%-m/%-d/%Y') AS month_first,
    day(o_orderdate) || ' ' || {NAMED}[month(o_orderdate)] || ' ' || year(o_orderdate) AS named_day,
    CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE ' ' || o_orderstatus END AS status,
    CASE WHEN o_orderkey % 1000 = 1 THEN '12:5)' ELSE CAST(o_custkey AS VARCHAR) END AS typo,
    (o_orderkey % 9 + 1) || ',' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS unsure FROM orders)"""
MESSY_COLUMNS = [
    "order_no", "customer_code", "local_money", "us_money", "plain_money", "signed_money", "iso_day", "day_first",
    "month_first", "named_day", "status", "typo", "unsure",
]

# ---- cells and texts ---------------------------------------------------------------------------------

SPACES = r"[\s\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]+"


@query("clean_cell", rf"""
    SELECT doc_id, md5(nullif(regexp_replace(regexp_replace(regexp_replace(chr(160) || text || chr(8203), '[\x{{a0}}\x{{2007}}\x{{202f}}]', ' ', 'g'),
        '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), '^{SPACES}|{SPACES}$', '', 'g'), '')) AS cleaned FROM documents""")
def clean_cell(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" "), F.col("text"), F.lit("​"))
    return t.documents.select("doc_id", F.md5(X.clean_cell(padded).cast("binary")).alias("cleaned"))


@query("fold_text", """
    SELECT doc_id, md5(strip_accents(replace(replace(replace(replace(replace(replace(lower(replace(replace(text, 'İ', 'i'), 'I', 'ı')),
        'ı', 'i'), 'ş', 's'), 'ğ', 'g'), 'ü', 'u'), 'ö', 'o'), 'ç', 'c'))) AS folded FROM documents""")
def fold_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.fold_text(F.col("text")).cast("binary")).alias("folded"))


@query("value_like", """
    SELECT kind, count(*) AS cells, count(*) FILTER (is_value) AS value_cells FROM (
        SELECT 'name' AS kind, false AS is_value FROM orders UNION ALL SELECT 'money', true FROM orders
        UNION ALL SELECT 'day', true FROM orders UNION ALL SELECT 'bracketed', o_orderkey % 3 <> 1 FROM orders
        UNION ALL SELECT 'named day', false FROM orders) GROUP BY 1""")
def value_like(t: Tables) -> DataFrame:
    m = messy_orders(t).withColumn("name", F.concat(F.lit("Customer "), F.col("customer_code")))
    kinds = {"name": "name", "money": "local_money", "day": "day_first", "bracketed": "signed_money", "named day": "named_day"}
    cells = m.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("v")) for k, c in kinds.items()])))
    return cells.groupBy("kind").agg(F.count("*").alias("cells"), F.count_if(X.value_like(F.col("v"))).alias("value_cells"))


@query("null_tokens", """
    SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN p_name WHEN p_partkey % 6 = 4 THEN 'Null Ltd.' END AS value FROM part""")
def null_tokens(t: Tables) -> DataFrame:
    marks = [" N/A ", "#SAYI/0!", "—", "NaN"]
    cell = F.when(F.col("p_partkey") % 6 == 5, F.concat(F.col("p_name"), F.lit("  "))).when(F.col("p_partkey") % 6 == 4, "Null Ltd.").otherwise(
        F.element_at(F.array(*[F.lit(m) for m in marks]), (F.col("p_partkey") % 6 + 1).cast("int"))
    )
    return t.part.select("p_partkey", V.present(cell).alias("value"))


@query("strip_money", f"SELECT CAST(o_orderkey AS VARCHAR) AS order_no, {LOCAL} AS local_text, format('{{:,.2f}}', o_totalprice) AS us_text FROM orders")
def strip_money(t: Tables) -> DataFrame:
    return messy_orders(t).select(
        "order_no", V.strip_money(F.concat(F.col("local_money"), F.lit(" % try"))).alias("local_text"), V.strip_money(F.col("us_money")).alias("us_text")
    )


@query("accounting_sign", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS order_no, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE '-' END || {LOCAL} AS signed FROM orders""")
def accounting_sign(t: Tables) -> DataFrame:
    return messy_orders(t).select("order_no", V.accounting_sign(V.strip_money(F.col("signed_money"))).alias("signed"))


@query("named_dates", "SELECT CAST(o_orderkey AS VARCHAR) AS order_no, strftime(o_orderdate, '%-d.%m.%Y') AS dotted FROM orders")
def named_dates(t: Tables) -> DataFrame:
    return messy_orders(t).select("order_no", V.dotted(F.col("named_day")).alias("dotted"))


@query("iso_dates", "SELECT CAST(o_orderkey AS VARCHAR) AS order_no, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dashed FROM orders")
def iso_dates(t: Tables) -> DataFrame:
    return messy_orders(t).select("order_no", V.dashed(F.replace(F.col("iso_day"), F.lit("-"), F.lit("/"))).alias("dashed"))


# ---- profile, decisions, conversion ---------------------------------------------------------------------


def _profile_sql() -> str:
    """The counters by plain SQL; dates are checked against the moment each text was rendered from."""
    marks = ", ".join("'" + m + "'" for m in V.NULL_MARKERS)
    noise = r"(₺|TL|TRY|USD|EUR|\$|€|%|\s)"

    def one(c: str) -> str:
        v = f"CASE WHEN lower(trim({c})) IN ({marks}) THEN NULL ELSE trim({c}) END"
        s = f"regexp_replace(v, '{noise}', '', 'gi')"
        m = rf"regexp_replace(regexp_replace(s, '^\(([0-9.,]+)\)$', '-\1'), '^([0-9.,]+)-$', '-\1')"
        shapes = ", ".join(f"count(*) FILTER (regexp_full_match(m, '{p}')) AS {n}" for n, p in V.SHAPES.items())
        fmts = "['%d.%m.%Y %H:%M:%S', '%d.%m.%Y']"
        iso = c == "iso_day"
        dmy = c in ("day_first", "month_first", "named_day")
        return rf"""SELECT '{c}' AS "column", count(v) AS n, {shapes}, count(*) FILTER (s <> v) AS stripped,
            {'count(v)' if iso else '0'} AS iso_shape, {'count(v)' if dmy else '0'} AS dmy_shape,
            {'count(v)' if iso else '0'} AS iso, {_dmy(c)} AS dmy, {'count(v)' if c == 'month_first' else '0'} AS mdy,
            count(*) FILTER (v LIKE '%:%' AND NOT regexp_matches(v, ' 0?0:00(:00(\.0+)?)?$')) AS time,
            coalesce(max(length(regexp_extract(m, '\.(\d+)$', 1))), 0) AS frac_dot,
            coalesce(max(length(regexp_extract(m, ',(\d+)$', 1))), 0) AS frac_comma
            FROM (SELECT *, {m} AS m FROM (SELECT *, {s} AS s FROM (SELECT {v} AS v FROM {MESSY})))"""

    def _dmy(c: str) -> str:
        if c in ("day_first", "named_day"):
            return "count(v)"
        if c == "month_first":  # month first read as day first: only days up to twelve are dates then
            return "count(*) FILTER (try_strptime(v, '%d/%m/%Y') IS NOT NULL)"
        return "0"

    return " UNION ALL ".join(one(c) for c in MESSY_COLUMNS)


@query("profile_text", _profile_sql())
def profile_text(t: Tables) -> DataFrame:
    return R.profile_text(messy_orders(t))


@query("date_check", f"""
    SELECT 'day_first' AS "column", count(*) AS n, 0 AS iso, count(*) AS dmy, 0 AS mdy FROM orders
    UNION ALL SELECT 'iso_day', count(*), count(*), 0, 0 FROM orders
    UNION ALL SELECT 'month_first', count(*), 0, count(*) FILTER (day(o_orderdate) <= 12), count(*) FROM orders
    UNION ALL SELECT 'local_money', count(*), 0, 0, 0 FROM orders
    UNION ALL SELECT c, count(*), 0, 0, 0 FROM orders, (VALUES ('us_money'), ('plain_money'), ('customer_code')) v(c) GROUP BY c""")
def date_check(t: Tables) -> DataFrame:
    return R.date_check(messy_orders(t), ["day_first", "iso_day", "month_first", "local_money", "us_money", "plain_money", "customer_code"])


KINDS = {
    "order_no": "integer", "customer_code": "text", "local_money": "tr-number", "us_money": "us-thousands", "plain_money": "decimal",
    "signed_money": "tr-number", "iso_day": "iso-date", "day_first": "dmy-date", "month_first": "mdy-date", "named_day": "dmy-date",
    "status": "text", "typo": "text", "unsure": "text",
}
SCALES = {"local_money": 2, "us_money": 2, "plain_money": 2, "signed_money": 2}
STRIPPED = ["local_money", "us_money", "signed_money"]
CONVERTED = STRIPPED + ["day_first", "month_first", "named_day"]


def _decisions_sql(with_scale: bool) -> str:
    def one(c: str, kind: str) -> str:
        scale = f"{SCALES.get(c, 0)} AS scale, {str(c == 'iso_day').lower()} AS with_time, " if with_scale else ""
        blocked = "(SELECT count(*) FILTER (o_orderkey % 1000 = 1) FROM orders)" if c == "typo" else "0"
        return f"""SELECT '{c}' AS "column", '{kind}' AS kind, {scale}{str(c in CONVERTED).lower()} AS converted,
            {str(c in STRIPPED).lower()} AS currency_stripped, {blocked} AS unreadable, {str(c == 'unsure').lower()} AS ambiguous"""

    return " UNION ALL ".join(one(c, k) for c, k in KINDS.items())


@query("type_decisions", _decisions_sql(True))
def type_decisions(t: Tables) -> DataFrame:
    return R.decide(R.profile_text(messy_orders(t)))


@query("cleaning_report", _decisions_sql(False))
def cleaning_report(t: Tables) -> DataFrame:
    return R.cleaning_report(messy_orders(t))


def converted(df: DataFrame, *decisions: R.Decision) -> DataFrame:
    return R.convert(df, list(decisions)).select("order_no", *[d.column for d in decisions if d.column != "order_no"])


@query("to_integer", "SELECT o_orderkey AS order_no, CASE WHEN o_orderkey % 1000 = 1 THEN NULL ELSE o_custkey END AS typo FROM orders")
def to_integer(t: Tables) -> DataFrame:
    return converted(messy_orders(t), R.Decision("order_no", "integer"), R.Decision("typo", "integer"))


def _to_number(name: str, column: str, kind: str, sign: str = "") -> None:
    @query(name, f"SELECT CAST(o_orderkey AS VARCHAR) AS order_no, CAST({sign} CAST(o_totalprice AS DECIMAL(38,2)) AS VARCHAR) AS amount FROM orders")
    def number(t: Tables) -> DataFrame:
        return converted(messy_orders(t), R.Decision(column, kind, 2)).select("order_no", F.col(column).cast("string").alias("amount"))


_to_number("to_decimal", "plain_money", "decimal")
_to_number("to_comma_decimal", "local_money", "tr-number")
_to_number("to_us_number", "us_money", "us-thousands")
_to_number("to_signed_decimal", "signed_money", "tr-number", "CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE -1 END *")


def _to_date(order: str, column: str) -> None:
    @query(f"to_date_{order}", "SELECT CAST(o_orderkey AS VARCHAR) AS order_no, CAST(o_orderdate AS DATE) AS day FROM orders")
    def date(t: Tables) -> DataFrame:
        return converted(messy_orders(t), R.Decision(column, f"{order}-date")).select("order_no", F.col(column).alias("day"))


for _order, _column in [("iso", "iso_day"), ("dmy", "named_day"), ("mdy", "month_first")]:
    _to_date(_order, _column)


@query("to_timestamp", """
    SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def to_timestamp(t: Tables) -> DataFrame:
    """Clock times with AM/PM."""
    written = t.events.select("event_id", F.date_format("ts", "d.M.yyyy h:mm:ss a").alias("at"))
    out = R.convert(written, [R.Decision("at", "dmy-date", with_time=True)])
    return out.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("clean_table", f"""
    SELECT o_orderkey AS order_no, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS customer_code, CAST(o_totalprice AS DECIMAL(38,2)) AS local_money,
           CAST(o_totalprice AS DECIMAL(38,2)) AS us_money, CAST(o_totalprice AS DECIMAL(38,2)) AS plain_money,
           CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS signed_money,
           o_orderdate AS iso_day, CAST(o_orderdate AS DATE) AS day_first, CAST(o_orderdate AS DATE) AS month_first,
           CAST(o_orderdate AS DATE) AS named_day, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status,
           CASE WHEN o_orderkey % 1000 = 1 THEN '12:5)' ELSE CAST(o_custkey AS VARCHAR) END AS typo,
           (o_orderkey % 9 + 1) || ',' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS unsure FROM orders""")
def clean_table(t: Tables) -> DataFrame:
    """Profile, decide and convert the whole messy table."""
    return R.clean_table(messy_orders(t))
