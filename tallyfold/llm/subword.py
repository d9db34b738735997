"""Bags of hashed words and character n-grams with learned vectors and a softmax, trained by numpy gradient descent.

A word lends itself and the n-grams of ``<space>word<space>`` with 3, 4 and 5 bytes; each is hashed to one of ``2**BITS`` vectors. A bag of
words is the average of its vectors, a linear softmax over it gives the probability of label 1. As the output is
linear in the average, a trained model is applied as one number per hashed feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BITS, DIMS, SIZES = 18, 8, (3, 4, 5)
CHUNK_WORDS = 1 << 15
_STEP = np.uint32(0x01000193)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_POWERS = np.cumprod(np.full(256, _STEP, np.uint32), dtype=np.uint32)
_SHIFT = np.uint32(32 - BITS)


def words_of(text: str, fold: bool) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if fold else data).split()


def _hashed(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Where each word starts in the joined bytes, per n the features and which of them are real, and the words' own features."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    spaces = data == 32
    at = np.flatnonzero(spaces)[:-1]
    wide = data.astype(np.uint32)
    run, out = wide.copy(), []
    seen = np.cumsum(spaces, dtype=np.int32)
    for n in range(2, SIZES[-1] + 1):
        run = run[: max(len(data) - n + 1, 0)] * _STEP + wide[n - 1:]
        if n in SIZES:
            inner = seen[n - 2: n - 2 + len(run)] == seen[: len(run)]
            out.append(((run * _MIX[n - SIZES[0]]) >> _SHIFT, inner))
    lengths = np.diff(np.append(at, len(data) - 1))
    place = np.arange(len(data) - 1) - np.repeat(at, lengths)
    own = np.add.reduceat(wide[:-1] * _POWERS[place & 255], at, dtype=np.uint32)
    return at, out, ((own ^ (own >> np.uint32(15))) * _MIX[3]) >> _SHIFT


def _counts(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return 1 + sum(np.maximum(sizes - n + 1, 0) for n in SIZES)


@dataclass
class Model:
    vectors: np.ndarray  # 2**BITS x DIMS
    weights: np.ndarray  # DIMS x 2
    bias: np.ndarray  # 2

    def applied(self) -> tuple[np.ndarray, float]:
        """The difference of the two outputs per feature, and of the biases."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def word_scores(words: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the sum of its features' numbers, and how many features it has."""
    sums, counts = [], []
    for lo in range(0, len(words), CHUNK_WORDS):
        part = words[lo:lo + CHUNK_WORDS]
        at, grams, own = _hashed(part)
        total = table[own].astype(np.float64)
        size = at[-1] + len(part[-1]) + 2
        for ids, real in grams:
            value = np.zeros(size, np.float32)
            value[: len(ids)] = table[ids] * real
            total += np.add.reduceat(value, at, dtype=np.float64)
        sums.append(total)
        counts.append(_counts(part))
    return (np.concatenate(sums), np.concatenate(counts)) if sums else (np.zeros(0), np.zeros(0, np.int64))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bag_scores(texts: list[str], model: tuple[np.ndarray, float], fold: bool, window: int | None) -> np.ndarray:
    """Probability of label 1 per text: of the whole text's bag, or the highest of its windows of so many words.

    A text without words has the empty bag: only the bias speaks.
    """
    table, bias = model
    out = np.full(len(texts), float(sigmoid(np.array(bias))))
    group, sizes, numbers = [], [], []

    def flush():
        if group:
            sums, counts = word_scores(group, table)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            if window is None:
                out[numbers] = sigmoid(np.add.reduceat(sums, starts) / np.add.reduceat(counts, starts) + bias)
            else:
                cuts = np.concatenate([np.arange(s, s + n, window) for s, n in zip(starts, sizes)])
                z = np.add.reduceat(sums, cuts) / np.add.reduceat(counts, cuts) + bias
                first = np.concatenate(([0], np.cumsum([-(-n // window) for n in sizes])[:-1]))
                out[numbers] = sigmoid(np.maximum.reduceat(z, first))
        group.clear(), sizes.clear(), numbers.clear()

    for i, text in enumerate(texts):
        words = words_of(text, fold)
        if words:
            group += words
            sizes.append(len(words))
            numbers.append(i)
        if len(group) >= CHUNK_WORDS:
            flush()
    flush()
    return out


def _bags(bags: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All features of the bags, and the bag of each."""
    words = [w for b in bags for w in b]
    owner_of_word = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    at, grams, own = _hashed(words)
    ids, owners = [own], [owner_of_word]
    word_at = np.zeros(at[-1] + len(words[-1]) + 2, np.int64)
    word_at[at[1:]] = 1
    word_at = np.cumsum(word_at)
    for hashed, real in grams:
        where = np.flatnonzero(real)
        ids.append(hashed[where])
        owners.append(owner_of_word[word_at[where]])
    return np.concatenate(ids).astype(np.int64), np.concatenate(owners)


class Trainer:
    """Stochastic gradient descent on bags; step sizes fall with each feature's own squared gradients."""

    def __init__(self, seed: int = 1, rate: float = 0.5):
        self.rng = np.random.default_rng(seed)
        self.rate = rate
        self.vectors = self.rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS)).astype(np.float32)
        self.weights = self.rng.normal(0, 0.1, (DIMS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.past = np.full(1 << BITS, 1e-4, np.float32)
        self.past_out = np.full((DIMS, 2), 1e-4, np.float32)

    def epoch(self, bags: list[list[bytes]], labels: np.ndarray, importance: np.ndarray, batch_words: int = 6000) -> None:
        order, at = self.rng.permutation(len(bags)), 0
        while at < len(order):
            picked, words = [], 0
            while at < len(order) and words < batch_words:
                picked.append(order[at])
                words += len(bags[order[at]])
                at += 1
            self._step([bags[i] for i in picked], labels[picked], importance[picked])

    def _step(self, bags, labels, importance) -> None:
        ids, owner = _bags(bags)
        size = np.bincount(owner, minlength=len(bags)).astype(np.float32)
        by_bag = np.argsort(owner, kind="stable")
        starts = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        mean = np.add.reduceat(self.vectors[ids[by_bag]], starts, axis=0) / size[:, None]
        z = mean @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = p
        off[np.arange(len(bags)), labels] -= 1
        off *= (importance / importance.sum())[:, None]
        back = (off @ self.weights.T) / size[:, None]
        out = mean.T @ off
        self.past_out += out * out
        self.weights -= self.rate * 0.2 * out / np.sqrt(self.past_out)
        self.bias -= self.rate * 0.2 * off.sum(axis=0)
        order = np.argsort(ids, kind="stable")
        touched, first = np.unique(ids[order], return_index=True)
        change = np.add.reduceat(back[owner[order]], first, axis=0)
        self.past[touched] += (change * change).mean(axis=1)
        self.vectors[touched] -= self.rate * change / np.sqrt(self.past[touched])[:, None]

    def model(self) -> Model:
        return Model(self.vectors, self.weights, self.bias)


def windows_of(words: list[bytes], window: int) -> Iterator[list[bytes]]:
    for lo in range(0, len(words), window):
        yield words[lo:lo + window]
