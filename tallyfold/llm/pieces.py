"""Texts as token ids, piece by piece.

Texts are cut at single spaces and each distinct piece is encoded once. A worker remembers pieces in a table that is bounded by the bytes it
holds; what is encoded at a time is bounded by bytes too, so a task's memory does not depend on the number or length of its texts
(one text is the least that is encoded at a time).
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TABLE_BYTES = 128 << 20
TEXT_BYTES = 8 << 20
# What Python holds for an entry besides the characters and ids: two objects and a slot of the table.
_ENTRY = 190


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces(dict):
    """Ids, as bytes, of the pieces met so far."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spell, self.letters, self.limit, self.held = self.tokenizer.model.tokenize, _byte_letters(), limit, 0

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def spelled(self, word: str) -> bytes:
        """The ids of a piece that the tokenizer never cuts; the table keeps them."""
        ids = self[word] = array("I", [t.id for t in self.spell(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self.held += _ENTRY + len(word) + len(ids)
        return ids

    def remember(self, piece: str, ids: bytes) -> bytes:
        self[piece] = ids
        self.held += _ENTRY + len(piece) + len(ids)
        return ids

    def forget(self) -> None:
        """Start anew once the table holds more than its limit."""
        if self.held > self.limit:
            self.clear()
            self.held = 0


class SpacedPieces(Pieces):
    """For byte-level vocabularies: a piece keeps the space before it, and only single spaces cut."""

    # A word, with its leading space, and the punctuation after it. Apostrophes are left out: the tokenizer may cut there.
    _WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
    _LINES = re.compile(r" ?\S+(?:\n\S+)+\Z")
    lead, apart = " ", "  "

    def __missing__(self, piece: str) -> bytes:
        if word := self._WORD.match(piece):
            base, tail = word.groups()
            if tail:
                return self[base] + self[tail]
            return self.spelled(piece)
        if self._LINES.match(piece):
            return self.remember(piece, self["\n"].join([self[x] for x in piece.split("\n")]))
        return self.remember(piece, self.whole(piece))


class LowerPieces(Pieces):
    """For vocabularies of lower-case words that drop white space: no piece depends on its neighbours. Pieces come with A-Z lower-cased."""

    _WORD = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
    lead, apart = "", None

    def __missing__(self, piece: str) -> bytes:
        if word := self._WORD.match(piece):
            base, tail = word.groups()
            if tail:
                return self[base] + self[tail]
            return self.spelled(piece)
        if "\n" in piece:
            return b"".join([self[x] for x in piece.split("\n") if x])
        return self.remember(piece, self.whole(piece))


def encode_column(texts: pa.Array, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each text has, and all ids in order.

    The pieces of all texts are numbered by Arrow, so each distinct one is looked up once, and gathered by their numbers.
    """
    known.forget()
    gc.disable()  # for these texts only: nothing here makes cycles, and the table is slow to walk
    try:
        return _encoded(texts, known)
    finally:
        gc.enable()


def _encoded(texts: pa.Array, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    plain, apart = texts, np.zeros(len(texts), bool)
    if known.apart is not None:
        apart = pc.match_substring(texts, known.apart).to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.if_else(pa.array(apart), "", texts) if apart.any() else texts
    pieces = pc.split_pattern(plain, " ")
    numbered = pieces.flatten().dictionary_encode()
    distinct, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64)
    at = pieces.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    lead = known.lead
    lists = [known[f"{lead}{x}"] for x in distinct]
    if known.lead and len(texts):
        # The first piece of a text has no space before it; texts that are encoded whole take its place.
        lists += [known.whole(t.as_py()) if odd else known[distinct[c]] for odd, t, c in zip(apart, texts, codes[at[:-1]])]
        codes[at[:-1]] = len(distinct) + np.arange(len(texts))
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 4)))
    store = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(lists), "<i4")))
    sizes = np.concatenate(([0], np.cumsum(np.diff(offsets)[codes])))
    return np.diff(sizes[at]), store.take(pa.array(codes)).flatten().to_numpy()


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most ``most`` bytes together, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")), lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


_loaded: dict[tuple[type, str], Pieces] = {}


def pieces_of(kind: Callable[[str, int], Pieces], path: str, limit: int = TABLE_BYTES) -> Pieces:
    """The worker's one table of this kind, within ``limit`` bytes from now on; tables of other kinds or files go."""
    if (kind, path) not in _loaded:
        _loaded.clear()
        _loaded[kind, path] = kind(path, limit)
    _loaded[kind, path].limit = limit
    return _loaded[kind, path]


def forget_pieces() -> None:
    _loaded.clear()
