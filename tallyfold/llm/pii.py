"""Personal data: base patterns, and bootstrapped contextual extraction on top of them, on DataFrame functions only.

1. Base identifiers of each kind are found by fixed patterns: email, ip, card, phone. They stay whatever follows.
2. Mentions are words with a digit or an at sign, or groups of digits joined by blanks, with the two words before them as their lexical pattern. Seeds are the mentions that lie in base
   identifiers; every other mention is unlabelled.
3. Patterns and instances form a graph per kind: a pattern's confidence is the share of its mentions that are of the kind,
   weighing each distinct instance by its own confidence; an instance is as sure as its patterns make it. A few rounds of joins
   and aggregates over (pattern, instance) pairs spread confidence from the seeds.
4. Patterns that are sure enough and rest on enough distinct seed instances add the unlabelled mentions they precede as spans of their kind, if
   the mention has the characters and the number of digits that the kind allows (``FORMS``), which is wider than the base patterns.

Places of matches come from splitting a text by the pattern: the pieces' and matches' lengths add up. Patterns take their
repeats whole (possessively) and start only where a run starts, so that long runs cost linear time; they match what the plain forms match.

Defined cases: a null text is empty; a document without spans has the digest of the empty text and no spans; repeated rows
are documents of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of, written

KINDS = ("email", "ip", "card", "phone")
MENTIONED = len(KINDS)
# The base patterns of the contract, with possessive repeats: fixed values.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Groups of digits joined by single blanks are one mention, as in a phone or card; any other mention is one word.
_GROUP = r"[+(]*+[0-9][0-9()./-]*+(?=[\s.,;:!?)\]}\x22'>]|$)"
MENTION = rf"(?<!\S)(?:{_GROUP}(?:(?<=[0-9)])\x20{_GROUP})++|(?=[^\s0-9@]*+[0-9@])\S++)"
# What a mention behind a sure pattern may look like, on its shape (letter runs as a, every digit as 9).
FORMS = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^(?=.*[9a])(?=.*[.:].*[.:])[9a.:]+(?:/9{1,3})?$",
    "card": r"^9(?:[\x20./-]?9){11,18}$",
    "phone": r"^[+(]*9(?:[\x20()./-]{0,3}9){6,14}$",
}
CONTEXT_CHARS = 80
ROUNDS, SURE, SUPPORT = 3, 0.8, 5


def _matches(kind: int, text: Column, pattern: str) -> Column:
    """Every match, leftmost and not overlapping: its number, the length and end of the text since the one before, the match."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    numbered = F.transform(found, lambda m, i: F.struct(i.alias("i"), m.alias("m")))
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), numbered, lambda g, x: F.struct(
        F.lit(kind).alias("kind"), x["i"].alias("i"), F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before"), x["m"].alias("m")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check: every second one from the right is doubled, its digits added."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _holds(kind: str, text: Column) -> Column:
    """A cheap test that spares most texts the pattern."""
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}[kind]


def located(docs: DataFrame) -> DataFrame:
    """row, kind, start, end, m, before: all base matches that pass their checks, and all mentions, with their places.

    ``docs`` has row and text. Places are running sums over the matches of one kind in one document.
    """
    text = F.col("text")
    nothing = F.array().cast("array<struct<kind:int,i:int,gap:int,before:string,m:string>>")
    each = [F.when(_holds(kind, text), _matches(no, text, PATTERNS[kind])).otherwise(nothing) for no, kind in enumerate(KINDS)]
    rows = docs.where(text.rlike("[0-9@]")).select("row", F.explode(F.concat(*each, _matches(MENTIONED, text, MENTION))).alias("x")).select("row", "x.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("m")).over(upto).cast("int")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))
    valid = F.col("kind") == MENTIONED
    for no, kind in enumerate(KINDS):
        valid = valid | ((F.col("kind") == no) & _valid(kind, F.col("m")))
    return placed.where(valid).select("row", "kind", "start", "end", "m", "before")


def mentions(places: DataFrame) -> DataFrame:
    """row, start, mention, pattern, shape, kind (of a base span that starts in it, or null).

    Mentions that lie behind the start of a base span are parts of it and left out.
    """
    mention = F.col("kind") == MENTIONED
    order = Window.partitionBy("row").orderBy("start", F.when(mention, 0).otherwise(1))
    upto, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    owned = places.withColumn("owner", F.max(F.when(mention, F.col("start"))).over(upto)).withColumn("reach", F.max(F.when(~mention, F.col("end"))).over(before))
    words = owned.groupBy("row", "owner").agg(
        F.max(F.when(mention, F.struct("m", "before", F.coalesce("reach", F.lit(0)).alias("reach")))).alias("x"), F.min(F.when(~mention, F.col("kind"))).alias("kind"))
    pattern = F.lower(F.regexp_replace(F.regexp_extract("x.before", r"((?:\S+\s+){1,2})$", 1), r"\s+", " "))
    core = F.regexp_replace(F.col("x.m"), r"[.,;:!?)\]}\x22'>]+$", "")
    shape = F.regexp_replace(F.regexp_replace("mention", r"\p{L}+", "a"), "[0-9]", "9")
    return words.where(F.col("x").isNotNull() & (F.col("x.reach") <= F.col("owner"))).select(
        "row", F.col("owner").alias("start"), core.alias("mention"), pattern.alias("pattern"), "kind").where(F.length("mention") > 0).withColumn("shape", shape)


def score_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence, support: patterns scored over the graph of patterns and instances."""
    graph = written(found.where(F.length("pattern") > 0).groupBy("pattern", "mention").agg(F.count("*").alias("n"), F.min("kind").alias("kind")), "pii-graph")
    seeds = graph.where(F.col("kind").isNotNull()).groupBy("mention", "kind").agg(F.lit(1.0).alias("sure"))
    totals = graph.groupBy("pattern").agg(F.count("*").alias("instances"))
    support = graph.where(F.col("kind").isNotNull()).groupBy("pattern", "kind").agg(F.count("*").alias("support"))
    links = written(graph.join(support.where(F.col("support") >= 2).select("pattern").distinct(), "pattern").select("pattern", "mention"), "pii-links")
    sure, scored = written(seeds, "pii-instances"), None
    for _ in range(rounds):
        reached = links.join(sure, "mention").groupBy("pattern", "kind").agg(F.sum("sure").alias("mass"))
        scored = written(reached.join(totals, "pattern").join(support, ["pattern", "kind"]).select("pattern", "kind", (F.col("mass") / F.col("instances")).alias("confidence"), "support"), "pii-patterns")
        # An instance is unsure only if all its patterns are: 1 - product of (1 - confidence). Seeds stay sure.
        doubt = links.join(scored.where(F.col("confidence") >= SURE / 2), "pattern").groupBy("mention", "kind").agg(F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))).alias("doubt"))
        sure = written(seeds.unionByName(doubt.select("mention", "kind", (1 - F.col("doubt")).alias("sure"))).groupBy("mention", "kind").agg(F.max("sure").alias("sure")), "pii-instances")
    return scored


def discovered(found: DataFrame, patterns: DataFrame, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """row, start, kind, end: unlabelled mentions behind a sure pattern, of a form that its kind allows."""
    fits = F.lit(False)
    for no, kind in enumerate(KINDS):
        fits = fits | ((F.col("kind") == no) & F.col("shape").rlike(FORMS[kind]))
    best = patterns.where((F.col("confidence") >= sure) & (F.col("support") >= support)).groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("pattern", F.col("best.kind").alias("kind"))
    new = found.where(F.col("kind").isNull()).drop("kind").join(best, "pattern").where(fits)
    return new.select("row", "start", "kind", (F.col("start") + F.length("mention")).cast("int").alias("end"))


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of base spans), spans (all) and n_added of every document."""
    listed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of("text").alias("text"))
    # Ids and places come from one pass that is written once, so a row number means the same document in both.
    marked = written(listed.select("row", "doc_id", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise("").alias("text")), "pii-texts")
    places = written(located(marked), "pii-places")
    found = written(mentions(places), "pii-mentions")
    added = discovered(found, score_patterns(found, rounds))
    span = F.struct("start", "kind", "end")
    spans = places.where(F.col("kind") != MENTIONED).select("row", span.alias("s"), F.lit(True).alias("base")).unionByName(added.select("row", span.alias("s"), F.lit(False).alias("base")))
    lists = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), F.col("s")))).alias("base"), F.sort_array(F.collect_list("s")).alias("every"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    joined = marked.select("row", "doc_id").join(lists, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("every", none).alias("every"))
    name = F.array(*map(F.lit, KINDS))

    def line(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == no)).cast("bigint")

    counts = [count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("every").alias("spans"), (F.size("every") - F.size("base")).cast("bigint").alias("n_added"))
