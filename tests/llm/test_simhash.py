"""Fingerprints and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tallyfold.llm import queries, simhash
from tallyfold.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    arr = np.array(fps, dtype="<u8")
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[:i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def compare(rows, docs):
    fps = [plain_print(t) for _, t in docs]
    want = sorted(zip(map(str, (d for d, _ in docs)), (f"{f:016x}" for f in fps), map(str, plain_components([d for d, _ in docs], fps))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    compare(queries.QUERIES["op2_simhash"](spark, SF).collect(), [(r.doc_id, r.text) for r in rows])


def test_odd_documents(spark):
    rng = random.Random(5)
    base = [rng.choice(["alpha", "Beta", "ÉTÉ", "été", "x1", "y z"]) + str(rng.randint(0, 50)) for _ in range(4000)]
    docs = [(100 + i, " ".join(base[:j] + ["odd"] + base[j:])) for i, j in enumerate(rng.sample(range(4000), 60))]
    docs += [(1, None), (2, ""), (3, " \t\n"), (None, None), (4, "one"), (5, "One two"), (6, "one two three"), (7, "A B C"), (7, "a b c"), (8, "a\tb\x0bc"), (None, "lone document here"), (9, "long " * 40000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 5, "k") for i, t in docs], DOCS + ", fp int, key string")
    compare(simhash.near_duplicates(df).collect(), docs)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.where("doc_id between 100 and 200").count() < 60
    assert simhash.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_crafted_fingerprints(spark, seed):
    """Every distance, in all segments; dense groups and chains."""
    rng = random.Random(seed)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(30):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want = plain_components(signed, fps)
    assert [found.get(x, x) for x in signed] == want
