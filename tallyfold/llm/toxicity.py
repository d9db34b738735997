"""Toxicity by subword bags: vectors of words and character n-grams are averaged and a linear softmax is trained jointly with them.

A toxic document may hold one toxic word in thousands, so the bag that is averaged is a window of 16 words and a document scores
as its most toxic window. Labels are per document: training starts with all windows of toxic documents as toxic, then
keeps only those that the model so far finds most toxic, against the windows of clean documents that it takes for toxic and random ones.
Misspellings share most n-grams with the words they come from.

Defined cases: null and empty texts have the empty bag's score; ids with contradicting labels are not learned from; without labels every score
is 0.5; repeated rows are scored alike; an empty table gives no rows; further columns are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfold.llm.common import text_of
from tallyfold.llm.labelled import PREDICTED_FROM, held_out, scored, training_sample
from tallyfold.llm.subword import Trainer, bag_scores, sigmoid, windows_of, word_scores, words_of

TRAINING_ROWS = 6_000
WINDOW = 16
# Gradient descent ends after so many windows, however few texts they come from.
_FIRST, _LATER = 100_000, 160_000


def train(texts: list[str], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    trainer = Trainer(seed)
    docs = [list(windows_of(words_of(t, True), WINDOW)) for t in texts]
    kept = [i for i, d in enumerate(docs) if d]
    docs, labels = [docs[i] for i in kept], labels[kept] if len(kept) else labels[:0]
    if not docs or labels.min() == labels.max():
        return np.zeros_like(trainer.model().applied()[0]), float(0 if not docs else 3 * (2 * labels[0] - 1))
    rng = np.random.default_rng(seed)
    seen = 0
    while seen < _FIRST + _LATER:
        table, bias = trainer.model().applied()
        bags, marks = [], []
        for windows, label in zip(docs, labels):
            if seen < _FIRST:
                picked = range(len(windows)) if label else rng.choice(len(windows), min(12, len(windows)), replace=False)
            else:
                z = _window_scores(windows, table)
                if label:
                    # Windows that stand out, one at least.
                    best = int(z.argmax())
                    picked = sorted({best, *np.flatnonzero(sigmoid(z + bias) > 0.5)[:40].tolist()})
                else:
                    picked = {*np.argsort(-z)[:6].tolist(), *rng.integers(0, len(windows), 4).tolist()}
            for i in picked:
                bags.append(windows[i])
                marks.append(label)
        marks = np.array(marks, np.int64)
        weight = np.ones(len(marks), np.float32)
        weight[marks == 1] *= (marks == 0).sum() / max((marks == 1).sum(), 1) * 0.5
        trainer.epoch(bags, marks, weight)
        seen += len(bags)
    return trainer.model().applied()


def _window_scores(windows: list[list[bytes]], table: np.ndarray) -> np.ndarray:
    sums, counts = word_scores([w for x in windows for w in x], table)
    cuts = np.arange(0, len(sums), WINDOW)
    return np.add.reduceat(sums, cuts) / np.add.reduceat(counts, cuts)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, trained on labels outside the held-out third."""
    kept = held_out(3, 1)
    model = train(*training_sample(docs, labels, "toxic", ~kept, rows))
    return scored(docs.select("doc_id", text_of("text").alias("text"), kept.alias("held_out")), model, fold=True, window=WINDOW)


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, in one pass over their rows; all columns stay."""
    model = train(*training_sample(docs, labels, "toxic", ~held_out(3, 1), rows))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                score = bag_scores([t or "" for t in part.column(at).to_pylist()], model, True, WINDOW)
                yield part.filter(pa.array(score < PREDICTED_FROM))

    return docs.mapInArrow(run, docs.schema)
