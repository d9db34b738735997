"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from tallyfold.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    cut = [(d, Counter(plain_terms(t))) for d, t in docs]
    cut = [(d, c, sum(c.values())) for d, c in cut if c]
    n_docs, length = len(cut), sum(n for *_, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for i, t in items:
        scored = []
        for d, c, n in cut:
            m = 10 + 90 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * c[x] // (1000 * c[x] + 8 * m)) for x in set(plain_terms(t)) if c[x])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(rng, n):
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(n)]


def test_search(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts(rng, 1500))]
    rows += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 W2, w3"), (8, "w1-w2_w3 é É日本 ÉÉ"), (9, None), (10, ""), (11, "?!"), (12, "w0 " * 30000 + "rare"), *[(3000 + i, "w5 w6 w200") for i in range(300)]]
    items = [(i, t) for i, t in enumerate(texts(rng, 40))] + [(3, "w1 w2 w3"), (None, "É日本 rare"), (50, None), (51, "nowhere"), (52, "..."), (53, "w0 w0 W0"), (54, "w5 w6 w200")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, item int, score string").repartition(3)
    asked = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, doc_id double")
    want = plain(rows, items)
    assert got(ranked.search(docs, asked)) == want
    # Small runs, all lists long or short, blocks of a few items: the same rows.
    monkeypatch.setattr(ranked, "RUN_DOCUMENTS", 100)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 20)
    assert got(ranked.search(docs, asked)) == want
    assert got(ranked.search(docs, asked, k=3)) == plain(rows, items, 3)
    assert ranked.search(docs.where("false"), asked).count() == ranked.search(docs, asked.where("false")).count() == 0


def test_lists_are_skipped():
    rng = np.random.default_rng(1)
    n, ids = 30_000, np.stack((np.zeros(30_000, np.int64), np.arange(30_000)), axis=1)
    for shares, short in (((0.9, 0.8, 0.5, 0.01, 0.003), 1 / 32), ((0.9, 0.8, 0.5, 0.01, 0.003), 0), ((0.9, 0.5), 1), ((0.02, 0.01), 1 / 32)):
        lists = []
        for share in shares:
            docs = np.flatnonzero(rng.random(n) < share).astype(np.int32)
            scores = rng.integers(1, 1000 + int(20 / share), len(docs))
            lists.append((docs, scores, int(scores.max())))
        best = ranked.Best(10)
        read = ranked.search_run(lists, n, ids, best, short)
        sums = np.zeros(n, np.int64)
        for d, s, _ in lists:
            sums[d] += s
        order = np.lexsort((np.arange(n), -sums))[:10]
        assert best.ids[:, 1].tolist() == order.tolist() and best.scores.tolist() == sums[order].tolist()
        if len(shares) > 2:
            assert read < 0.25 * sum(len(d) for d, *_ in lists)
