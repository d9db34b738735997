"""Top products against all products."""

import math
import random

import numpy as np

from tallyfold.llm import topk


def plain(rows, k=10, every=100):
    one = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[1]):
        one.setdefault(i, [math.floor(1024 * float(np.float32(x))) for x in v])
    out = []
    for q, a in one.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in one.items() if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_products(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 6) for i in range(400)] + [(2000 + i, [0.5, 0.25]) for i in range(5)] + [(2100, [0.5, 0.25])]
    rows += [(3000, None), (3001, [None, 1.0] * 3), (3002, [math.nan] * 6), (3003, [math.inf] * 6), (None, [1.0] * 6), (3100, []), (3101, []), (0, rows[0][1]), (3200, [1e30] * 3), (3201, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, rank string")
    got = sorted(map(tuple, topk.self_top_products(df).collect()))
    want = plain(rows)
    clipped = [(q, r, i, min(max(s, -2 ** 63 + 1), 2 ** 63 - 1)) for q, r, i, s in want]
    assert got == clipped
    assert topk.self_top_products(df.where("false")).count() == 0


def test_pruning_keeps_the_result():
    rng = np.random.default_rng(1)
    data = np.floor(1024 * np.concatenate([rng.normal(c, 0.05, (300, 8)) for c in rng.normal(0, 1, (10, 8))]))
    found = topk.Search(data[::50], np.arange(0, 3000, 50), data, np.arange(3000), 10)
    visited = []
    take = found.take
    found.take = lambda rows, points: (visited.append(len(rows) * len(points)), take(rows, points))
    found.run()
    assert sum(visited) < 0.5 * 60 * 3000
    for n, q in enumerate(range(0, 3000, 50)):
        scores = data @ data[q]
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:10]
        assert [(-int(s), i) for s, i in best] == list(zip(found.scores[n].tolist(), found.ids[n].tolist()))
