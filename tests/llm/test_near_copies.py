"""The pipeline's near-copy stage against all pairs by shingle Jaccard."""

import hashlib
import random
import re

import corpus_pipeline
from tallyfold.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_kept(docs):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    meet = {}
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in meet.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            meet[g].append(i)
        if not s:
            shared |= {j: 0 for j in range(i) if not sets[j]}
        for j, both in shared.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, (d, t) in enumerate(docs):
        order = (d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest())
        first[find(i)] = min(first.get(find(i), (order, i)), (order, i))
    return sorted((str(docs[i][0]), docs[i][1] or "") for _, i in first.values())


def kept_rows(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())


def test_stage_on_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    kept = kept_rows(corpus_pipeline.without_near_copies(spark, df, SF))
    assert kept == plain_kept([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_stage_on_edited_copies(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = [(1, None), (2, ""), (3, " \n"), (None, "one two"), (4, "One two"), (5, "one two"), (6, "one")]
    for group in range(60):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        for copy in range(6):
            made = [word() if rng.random() < rng.choice([0.005, 0.02, 0.04]) else w for w in base]
            docs.append((100 + group * 10 + copy, " ".join(made)))
    chain = [word() for _ in range(200)]
    for i in range(40):
        chain = chain[4:] + [word() for _ in range(4)]
        docs.append((5000 + i, " ".join(chain)))
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in docs], DOCS + ", name int")
    kept = corpus_pipeline.without_near_copies(spark, df, SF)
    assert kept.columns == df.columns
    assert kept_rows(kept) == plain_kept(docs)
    assert corpus_pipeline.without_near_copies(spark, df.where("false"), SF).count() == 0


def test_rows_are_judged_by_text_and_id(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, "a b c d e f"), (1, "an other text of that id"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "no id here at all"), (None, "no id here at all"),
            (3, "twice the same row with id"), (3, "twice the same row with id"), (4, long), (5, long + " more"), (6, None), (7, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "n", n) for n, (i, t) in enumerate(docs)], DOCS + ", name string, root int").repartition(3)
    kept = corpus_pipeline.without_near_copies(spark, df, SF)
    assert kept.columns == df.columns and kept_rows(kept) == plain_kept(docs)
    assert kept_rows(kept) == sorted([("1", "a b c d e f"), ("1", "an other text of that id"), ("None", "no id here at all"), ("3", "twice the same row with id"), ("4", long), ("6", "")])


def edited_group(rng, n, shares):
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    return [" ".join(f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in base) for share in (rng.choice(shares) for _ in range(n))]


def test_maps_bound_the_similarity():
    rng, near = random.Random(3), 0
    for text, other in zip(edited_group(rng, 400, (0.005, 0.02, 0.03)), edited_group(random.Random(3), 400, (0.01, 0.02, 0.04))):
        x, y = near_copies.shingles(text), near_copies.shingles(other + " and some more" * rng.randrange(30))
        both = len(set(x.tolist()) & set(y.tolist()))
        a, b = (near_copies._Member(0, b"", b"", len(s), near_copies.bit_map(s)) for s in (x, y))
        if both >= 0.8 * (len(x) + len(y) - both):
            near += 1
            assert near_copies.near_enough(a, b, 0.8)
    far = [near_copies._Member(0, b"", b"", len(s), near_copies.bit_map(s)) for s in map(near_copies.shingles, ("a b c d e f g", "h i j k l m n"))]
    assert near > 20 and not near_copies.near_enough(*far, 0.8)


def test_dense_group_in_parts_and_homes(spark, monkeypatch):
    docs = list(enumerate(edited_group(random.Random(4), 150, (0.005, 0.02, 0.03, 0.05))))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    expected = plain_kept(docs)
    assert 20 < len(expected) < 130
    assert kept_rows(corpus_pipeline.without_near_copies(spark, df, SF)) == expected
    monkeypatch.setattr(near_copies, "KEY_ROWS", 7)
    monkeypatch.setattr(near_copies, "HOME_BYTES", 5000)
    assert kept_rows(corpus_pipeline.without_near_copies(spark, df, SF)) == expected


def test_fingerprint_chains_come_first(spark, monkeypatch):
    """The stage's groups begin with the pigeonring chains; without any key pairs, what they link and the sets confirm is still grouped."""
    base = [f"w{i}" for i in range(4_000)]
    close = [" ".join([*base[:at], "edited", *base[at + 1:]]) for at in (700, 1500, 3200)]
    docs = list(enumerate([" ".join(base), *close, "an other text", "one more that is not alike"]))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    prints = [simhash.majority(near_copies.hashed_shingles(t)) for _, t in docs]
    assert all(0 < (p ^ prints[0]).bit_count() <= 3 or p == prints[0] for p in prints[1:4])
    none = lambda rooted, *rest: rooted.select(*near_copies._pair(rooted["name"], rooted["root"])).where("false")
    monkeypatch.setattr(near_copies, "_with_representative", none)
    monkeypatch.setattr(near_copies, "_across", none)
    assert kept_rows(corpus_pipeline.without_near_copies(spark, df, SF)) == plain_kept(docs)


def shuffled(spark, make):
    """Bytes that the stages of ``make`` write to shuffles."""
    store, scheduler = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().dagScheduler()
    begin = scheduler.nextStageId()
    made = make()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for i in range(begin, scheduler.nextStageId()):
        try:
            total += store.lastStageAttempt(i).shuffleWriteBytes()
        except Exception:  # a stage that was skipped
            continue
    return made, total


def test_rows_that_stay_are_not_shuffled(spark):
    """Texts that are no copies stay where they are, and a text's keys are shuffled once, however large the other sides of the joins are."""
    rng = random.Random(11)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(600)) for _ in range(300)]
    texts += texts[:20]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = near_copies.written(df, "test-docs")
        kept, moved = shuffled(spark, lambda: kept_rows(near_copies.written(corpus_pipeline.without_near_copies(spark, docs, SF), "test-kept")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert kept == sorted((str(i), t) for i, t in enumerate(texts[:300]))
    assert 0 < moved < 0.5 * sum(map(len, texts))
