"""Quality by supervised subword embeddings: learned vectors of hashed words and character n-grams, averaged per document, and a softmax.

Case and punctuation are kept, as shouting, symbols and table debris are what bad text shows. Training draws a few stretches of words from each
labelled text per epoch; a document is scored by the average over all its words.

Defined cases: null and empty texts have the empty bag's score; ids with contradicting labels are not learned from; without labels every score
is 0.5; repeated rows are scored alike; an empty table gives no rows; further columns are never inputs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyfold.llm.common import text_of
from tallyfold.llm.labelled import held_out, scored, training_sample
from tallyfold.llm.subword import Trainer, words_of

TRAINING_ROWS = 6_000
STRETCH_WORDS = 150
DRAWN = 30_000  # stretches that gradient descent sees, however few texts they come from


def train(texts: list[str], labels: np.ndarray, seed: int = 2) -> tuple[np.ndarray, float]:
    trainer, rng = Trainer(seed), np.random.default_rng(seed)
    docs = [words_of(t, False) for t in texts]
    kept = [i for i, d in enumerate(docs) if d]
    docs, labels = [docs[i] for i in kept], labels[kept] if len(kept) else labels[:0]
    if not docs or labels.min() == labels.max():
        return np.zeros_like(trainer.model().applied()[0]), float(0 if not docs else 3 * (2 * labels[0] - 1))
    for _ in range(-(-DRAWN // len(docs))):
        starts = [int(rng.integers(0, max(len(d) - STRETCH_WORDS, 0) + 1)) for d in docs]
        trainer.epoch([d[s:s + STRETCH_WORDS] for d, s in zip(docs, starts)], labels, np.ones(len(docs), np.float32))
    return trainer.model().applied()


def quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, trained on labels outside the held-out quarter."""
    kept = held_out(4, 2)
    model = train(*training_sample(docs, labels, "quality", ~kept, rows))
    return scored(docs.select("doc_id", text_of("text").alias("text"), kept.alias("held_out")), model, fold=False, window=None)
