"""Suffix arrays and repeat removal against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyfold.llm import queries, repeats
from tallyfold.llm.suffix import common_prefixes, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 7, 60, 400):
        for letters in (1, 2, 4, 300):
            text = rng.integers(0, letters, n)
            order = suffix_array(text, n)
            want = sorted(range(n), key=lambda i: text[i:].tolist())
            assert order.tolist() == want
            lcp = common_prefixes(text, order, n)
            for k in range(1, n):
                a, b = text[want[k - 1]:], text[want[k]:]
                m = min(len(a), len(b))
                same = a[:m] == b[:m]
                assert lcp[k] == (m if same.all() else same.argmin())


def plain(docs, length=400):
    """All windows of all texts in one counter."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(hash(b[i:i + length]) for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i:i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        runs = int((cut & ~np.append(False, cut[:-1])).sum()) if len(cut) else 0
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        out.append((str(d), len(b), int(cut.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.QUERIES["op1_repeats"](spark, SF)) == plain(docs)


def odd_documents():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "é", "日本", "x"]) + str(rng.randint(0, 999))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(120), text(140)
    docs = [(1, None), (2, ""), (3, "short"), (3, "short"), (4, "a" * 399), (5, "a" * 400), (6, "a" * 401), (7, "ab" * 900), (8, text(3000))]
    for length in (398, 399, 400, 401, 430, 431, 432, 500):
        part = "".join(rng.choice("abcdef") for _ in range(length))
        docs += [(100 + length, text(30) + part + text(40)), (2000 + length, part + text(3)), (3000 + length, text(5) + part)]
    for i in range(40):
        words = passage.split()
        words[rng.randrange(len(words))] = word()
        docs.append((5000 + i, f"{text(rng.randint(0, 20))} {' '.join(words)} {text(rng.randint(0, 20))}"))
    docs += [(6000 + i, text(rng.randint(0, 60)) + other + text(rng.randint(0, 60))) for i in range(20)]
    docs += [(None, other), (7000, other), (7000, other), (7001, other + other), (7002, text(50) + other[:410] + text(50) + other[:410])]
    return docs


@pytest.mark.parametrize("group_rows", [50_000, 3])
def test_odd_documents(spark, monkeypatch, group_rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    docs = odd_documents()
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in docs], DOCS + ", core int, left string, d1 int")
    made = repeats.remove_repeats(df)
    assert rows(made) == plain(docs)
    if group_rows == 50_000:
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in made.collect())
        assert repeats.remove_repeats(df.where("false")).count() == 0


def test_pieces_hold_every_window_once(spark):
    """Edited copies, whose runs often meet at places that agree modulo the step."""
    rng = random.Random(13)
    docs = []
    for i in range(300):
        text = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000)]
        docs.append((2 * i, "".join(text)))
        for at in rng.sample(range(4000), 4):
            text[at] = "#"
        docs.append((2 * i + 1, "".join(text)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    assert rows(repeats.remove_repeats(df)) == plain(docs)
