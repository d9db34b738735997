"""Personal data and decontamination against plain versions."""

import hashlib
import random
import re

from tallyfold.llm import decontaminate, pii, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_ok(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_spans(text):
    out = [(m.start(), no, m.end()) for no, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if plain_ok(kind, m[0])]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def check_pii(rows, docs):
    want = sorted((str(d), hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest()) for d, t in docs)
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
    by_id = {str(d): plain_spans(t) for d, t in docs}
    for r in rows:
        if sum(str(d) == str(r.doc_id) for d, _ in docs) == 1:
            base = by_id[str(r.doc_id)]
            assert set(base) <= set(r.spans.split(",")) | {""} and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in pii.KINDS]


def test_personal_data_of_table(spark):
    check_pii(queries.QUERIES["op4_pii"](spark, SF).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_personal_data_of_odd_texts(spark):
    rng = random.Random(4)
    texts = [None, "", "a@b.c_d@e.f", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (555) 123-4567 and +1 (5", "+49..30 1234567)", "é🙂 a@b.co é",
             "1 2 3 4 " * 3000, "9" * 50000, "a" * 50000 + "@", "a.b-" * 20000, "+1 " * 5000, "tel 00000000000000000"]
    texts += ["".join(rng.choice("0123456789  --..++()@ab4111é") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    docs = list(enumerate(texts)) + [(None, "q@r.st"), (7, "repeat 1.1.1.1"), (7, "repeat 1.1.1.1")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "k", 2) for i, t in docs], DOCS + ", row int, kind string, start int")
    check_pii(pii.find_personal_data(df).collect(), docs)
    assert pii.find_personal_data(df.where("false")).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    docs = [(i, f"Please write to: user{i}@mail.example.com today") for i in range(30)] + [(50, "Please write to: odd@host now"), (51, "version 2.0 of it")]
    docs += [(60 + i, f"please write to: x{i}@localhost") for i in range(3)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    seen = {r.doc_id: r for r in pii.find_personal_data(df.unionByName(spark.createDataFrame([(200 + i, f"Please write to: a{i}@{i}.example shop-{i}@x", "en", "s", 0) for i in range(20)], DOCS))).collect()}
    assert seen[51].spans == "" and seen[50].n_email == 0
    found = pii.mentions(pii.located(df.selectExpr("doc_id AS row", "text")))
    scores = {(r.pattern, r.kind): r for r in pii.score_patterns(found).collect()}
    assert scores["write to: ", 0].confidence >= pii.SURE and scores["write to: ", 0].support == 30
    shaped = found.selectExpr("row", "start", "mention", "pattern", "kind", "CASE WHEN shape LIKE 'a%@a' THEN 'a@a.a.a' WHEN shape LIKE 'a9@%' THEN 'a@a.a.a' ELSE shape END AS shape")
    added = {r.row: (r.start, r.end) for r in pii.discovered(shaped, pii.score_patterns(found)).collect()}
    assert added[50] == (17, 25) and 51 not in added


def plain_hits(docs, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    cuts = {(i, tuple(w[s:s + width])) for i, t in items for w in [words(t)] if w for s in range(max(len(w) - width + 1, 1))}
    by = {}
    for i, g in cuts:
        by.setdefault(g, set()).add(i)
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(g) for g in by}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s:s + n])) in by:
                    hit |= set(range(s, s + n))
                    named |= by[g]
        ids = sorted(str(i) for i in named if i is not None)
        out.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark):
    rng = random.Random(9)
    words = ["Été", "été", "É", "é", "the", "of", "x9", "a", "b", "c", "日本", "ÿ", "Ã‰"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, text(30)), (2, text(10)), (3, text(4)), (4, "!!"), (5, None), (6, text(12)), (None, "no id item"), (6, "again the of"), (11, text(9))]
    docs = [(i, text(60)) for i in range(60)]
    docs += [(100 + k, f"{text(5)}, {t.replace(' ', '--')} {text(3)}") for k, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "no id item"), (None, items[1][1]), (203, items[0][1]), (203, items[0][1]), (204, (items[0][1] + " ") * 400), (205, "É é")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "w") for i, t in docs], DOCS + ", row int, term string")
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, count int")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == plain_hits(docs, items)
    kept = decontaminate.clean_documents(df, bench)
    assert kept.columns == df.columns
    hit = {text for (_, text), row in zip(docs, [plain_hits([d], items)[0] for d in docs]) if row[-1]}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(d) for d in docs if d[1] not in hit)
    shared = spark.createDataFrame([(1, items[0][1]), (1, "of its own"), (None, items[1][1]), (None, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in decontaminate.clean_documents(shared, bench).collect()) == ["None", "of its own"]
    assert decontaminate.decontaminate(df.where("false"), bench).count() == 0
    assert decontaminate.decontaminate(df, bench.where("false")).where("contaminated or n_hit > 0").count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(0, "b a z d c e", "en", "s", 0), (1, "a x x x x x b c d e", "en", "s", 0)], DOCS)
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    windows = decontaminate.benchmark_windows(bench, 5)
    anchored = decontaminate.anchors(windows, decontaminate.term_counts(df, windows.selectExpr("explode(words) AS term").distinct()))
    index = decontaminate.postings(df, anchored.select("term"), 4 + 2)
    ids = index.where("around IS NULL").select("row", "doc_id")
    near = decontaminate.proximity_matches(index, anchored, 1).join(ids, "row").select("doc_id").distinct().collect()
    assert [r.doc_id for r in near] == [0]
    assert decontaminate.phrase_matches(index, anchored).count() == 0


def test_unseen_forms_are_added_whole(spark):
    seeds = [f"call me at +1 (743) 555-{3000 + i} today" for i in range(30)]
    seeds += [f"write to me: user{i}@mail.example.com today" for i in range(30)]
    seeds += [f"came from host 10.20.30.{i} today" for i in range(30)]
    cards = (f"4111 1111 1111 {i:04d}" for i in range(4000))
    seeds += [f"charged to card {c} today" for c in [c for c in cards if plain_ok("card", c)][:30]]
    unseen = ["(743) 555-3824", "743 555 3824", "odd@host", "fe80::1:2", "4111 1111 1111 1112"]
    texts = [f"call me at {unseen[0]}. Thanks", f"call me at {unseen[1]} today", f"write to me: {unseen[2]} today", f"came from host {unseen[3]} today", f"charged to card {unseen[4]}, today"]
    others = ["call me at 10 today", "version 2.0 of it", "came from host 7 today", "charged to card 12 today", "room 743 555 3824 here"]
    docs = list(enumerate(seeds + texts + others))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for at, (text, part, kind) in enumerate(zip(texts, unseen, ["phone", "phone", "email", "ip", "card"]), len(seeds)):
        start = text.index(part)
        assert (got[at].spans, got[at].n_added) == (f"{kind}:{start}:{start + len(part)}", 1), text
    assert all(got[i].n_added == 0 for i, _ in docs if not len(seeds) <= i < len(seeds) + len(texts))
