"""Whitening against the eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from tallyfold.llm import whitening


def plain(rows, most=16):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    d = (n * fit - sums).astype(float) / n
    values, axes = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-values)[:most]
    values, axes = values[order], axes[:, order]
    x = np.array([x for _, x in kept], dtype=object)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return kept, n, deviation, ((n * x - sums).astype(float) / n) @ axes / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(d.T @ d / n)


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(0, 1, (20, 20)) * np.linspace(2, 0.05, 20)
    v = (rng.normal(0, 1, (3000, 20)) @ mixing + rng.normal(0, 5, 20)).astype(np.float32)
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(5000 + i, v[0].tolist()) for i in range(900)] + [(None, v[1].tolist()), (7, v[2].tolist())]
    odd = [(9000, None), (9001, []), (9002, [None] * 20), (9003, [math.nan] * 20), (9004, [math.inf] + [0.0] * 19), (9005, [1.0] * 3)]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows + odd], "vec_id long, embedding array<float>, n int, component string").repartition(4)
    got = whitening.whiten(df).toPandas()
    kept, n, deviation, whitened, explained = plain(rows)
    assert len(got) == len(kept) * 16 and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    got["vec_id"] = got["vec_id"].fillna(-1).astype(int)
    table = got.pivot_table(index="vec_id", columns="component", values="whitened", aggfunc="first")
    deviations, share = got.groupby("vec_id")["deviation"].first(), got.groupby("component")["explained"].first()
    assert np.allclose(share, explained, rtol=1e-9)
    signs = None
    for (i, _), dev, want in zip(kept, deviation, whitened):
        key = -1 if i is None else i
        if key == 7:
            continue
        assert deviations[key] == dev
        have = table.loc[key].to_numpy()
        signs = np.sign(have * want) if signs is None else signs
        assert np.allclose(have, want * signs, rtol=1e-6, atol=1e-7)
    assert len(got[got["vec_id"] == 7]) == 32


def test_few_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in (0, 1, 1, 5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).toPandas()
    assert set(got["component"]) == {1} and len(got) == 4 and abs(got["explained"][0] - 1) < 1e-12
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0
    assert whitening.whiten(df.where("false")).count() == 0
    far = spark.createDataFrame([(1, [1e9]), (2, [-1e9])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}


@pytest.mark.parametrize("rank", [1, 5, 30])
def test_factor_and_rotation(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(0, 1, (30, rank)) * np.logspace(0, -5, rank)
    v = a @ a.T
    l = whitening.pivoted_cholesky(v)
    assert l.shape[1] == rank and np.allclose(l @ l.T, v, atol=1e-13)
    order = np.argsort(-np.count_nonzero(l, axis=1), kind="stable")[::-1]
    assert np.allclose(np.triu(l[order][:rank], 1), 0)
    values, axes = whitening.one_sided_jacobi(l)
    assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-13)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-7, atol=1e-13)
    assert np.allclose(v @ axes, axes * values, atol=1e-13)
