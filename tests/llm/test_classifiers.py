"""Held-out accuracy of the classifiers, their odd cases, and the pipeline's stages."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyfold.llm import decontaminate, mixing, quality, queries, toxicity
from tallyfold.llm.labelled import held_out, training_sample
from tallyfold.llm.subword import Trainer, _bags, word_scores, words_of
from test_near_copies import kept_rows, plain_kept

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(toxicity, "_FIRST", 30_000)
    monkeypatch.setattr(toxicity, "_LATER", 40_000)
    monkeypatch.setattr(quality, "DRAWN", 6_000)


def test_scores_are_sums_of_features():
    words = ["a", "to", "word,", "é", "日本語", "x" * 300, "Word"]
    table = np.random.default_rng(0).normal(size=1 << 18).astype(np.float32)
    sums, counts = word_scores([w.encode() for w in words], table)
    ids, owner = _bags([[w.encode()] for w in words])
    assert np.allclose(sums, np.bincount(owner, table[ids], len(words)), rtol=1e-4, atol=1e-3)
    assert counts.tolist() == np.bincount(owner, minlength=len(words)).tolist()


def plain_marks(docs, labels, column, modulus, remainder):
    return {d: (zlib.crc32(str(d).encode()) % modulus == remainder, lab[column]) for d, lab in labels.items() if d in docs}


@pytest.mark.parametrize("name, column, modulus, remainder, least", [("op5_toxicity", "toxic", 3, 1, 0.8), ("op10_quality", "quality", 4, 2, 0.85)])
def test_held_out_accuracy(spark, name, column, modulus, remainder, least):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for d, (held, label) in plain_marks(got, labels, column, modulus, remainder).items():
        assert got[d].held_out == held and 0 <= got[d].score <= 1 and got[d].predicted == int(got[d].score >= 0.7)
        if held:
            right.append(got[d].predicted == label)
    assert np.mean(right) >= least


def test_odd_inputs(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x") for i, t in [(1, None), (2, ""), (None, "word"), (3, "word " * 50000), (3, "x" * 100000)]], DOCS + ", score double, label string")
    for made in (toxicity.toxicity(df, labels), quality.quality(df, labels), toxicity.toxicity(df, labels.where("false"))):
        assert [r.score for r in made.collect()] == [0.5] * 5
    assert toxicity.toxicity(df.where("false"), labels).count() == 0
    assert toxicity.keep_clean(df, labels).count() == 5


def test_misspellings_share_vectors():
    clean, bad = ["the and of with this", "onto ering thand"], ["the idiot of with", "an idiotic this"]
    table, bias = toxicity.train(clean * 30 + bad * 30, np.array([0] * 60 + [1] * 60))
    sums, counts = word_scores([b"idiooot", b"thand"], table)
    assert (sums / counts)[0] > (sums / counts)[1]
    assert Trainer(1).vectors.shape[1] == 8


def plain_scores(docs, labels):
    """What a plain loop over the texts gives with the trained model: every window's mean, the worst one counts."""
    table, bias = toxicity.train(*training_sample(docs, labels, "toxic", ~held_out(3, 1), toxicity.TRAINING_ROWS))
    for r in docs.collect():
        words = words_of(r.text or "", True)
        sums, counts = word_scores(words, table) if words else (np.zeros(0), np.zeros(0))
        means = [sums[i:i + toxicity.WINDOW].sum() / counts[i:i + toxicity.WINDOW].sum() for i in range(0, len(words), toxicity.WINDOW)]
        yield r, 1 / (1 + np.exp(-(max(means, default=0.0) + bias)))


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    now, steps = docs.withColumn("mix_times", docs["n_chars"]).withColumn("word", docs["lang"]), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == [*docs.columns, "mix_times", "word"]
        now = spark.createDataFrame(now.collect(), now.schema)
        steps.append(now)
    ids = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in steps]
    sure = {r.doc_id: s for r, s in plain_scores(docs, labels) if abs(s - 0.7) > 1e-3}
    assert len(sure) > 190 and {d for d, s in sure.items() if s >= 0.7}
    assert all((d in ids[0]) == (s < 0.7) for d, s in sure.items())
    assert kept_rows(steps[1]) == plain_kept([(r.doc_id, r.text) for r in steps[0].collect()])
    assert set(ids[2]) == {r.doc_id for r in decontaminate.decontaminate(steps[1], spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated").collect()}
    took = {r.doc_id: -(-r.taken // r.size) if r.size else 1 for r in mixing.mix(steps[2]).collect()}
    assert ids[3] == Counter({d: n for d, n in took.items() if n})
    out = corpus_pipeline.STAGES[-1][1](spark, steps[3], sf).collect()
    assert Counter(r.doc_id for r in out) == ids[3]
