"""Packing: a whole and gapless assignment, fixed sets that cost nothing against the best packing, ids as the tokenizer gives them."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from tallyfold.llm import packing
from tallyfold.llm.pieces import LowerPieces, by_bytes, encode_column

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def checked(counts, capacity):
    """The number of sequences of a plan, after placing every document by its rows."""
    made = packing.plan(counts, capacity)
    content = defaultdict(list)
    numbers = defaultdict(set)
    for size, first, many, sequence, each, at in made.rows:
        for turn in range(many):
            assert first + turn not in numbers[size]
            numbers[size].add(first + turn)
            content[sequence + turn // each].append((at + turn % each * size, size))
    assert {s: len(n) for s, n in numbers.items()} == {s: n for s, n in counts.items() if n}
    assert all(max(n) == len(n) - 1 for n in numbers.values())
    assert set(content) == set(range(made.sequences))
    for placed in content.values():
        end = 0
        for offset, size in sorted(placed):
            assert offset == end
            end += size
        assert end <= capacity
    return made


def best_possible(sizes, capacity):
    @cache
    def fewest(left):
        if not left:
            return 0
        best = len(left)
        rest = left[1:]
        for mask in range(1 << len(rest)):
            if left[0] + sum(s for i, s in enumerate(rest) if mask >> i & 1) <= capacity:
                best = min(best, 1 + fewest(tuple(s for i, s in enumerate(rest) if not mask >> i & 1)))
        return best

    return fewest(tuple(sorted(sizes, reverse=True)))


def test_fixed_sets_are_in_a_best_packing():
    rng = random.Random(4)
    fixed = 0
    for _ in range(250):
        capacity = rng.randint(8, 40)
        sizes = [rng.randint(1 if rng.random() < 0.5 else capacity // 4 + 1, capacity) for _ in range(rng.randint(1, 8))]
        reduced = packing.Plan(Counter(sizes), capacity)
        reduced.reduce()
        fixed += reduced.fixed
        assert reduced.fixed + best_possible(reduced.left.elements(), capacity) == best_possible(sizes, capacity)
    assert fixed > 300


@pytest.mark.parametrize("content, capacity, counts", [
    ([9], 10, {9: 1, 5: 2}), ([7, 3], 10, {7: 1, 3: 1, 2: 1, 1: 1}), ([6, 3], 10, {6: 1, 3: 2}), ([5, 4], 10, {5: 1, 4: 1, 2: 2}), ([4, 3, 2], 10, {4: 1, 3: 1, 2: 2}),
])
def test_criteria(content, capacity, counts):
    made = packing.Plan(counts, capacity)
    assert made.dominating(content[0], sorted(made.left)) == content


def best_fit_falling(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= s
        else:
            room.append(capacity - s)
    return len(room)


def test_plans_are_whole_and_as_good_as_best_fit():
    rng = random.Random(5)
    for turn in range(60):
        capacity = rng.choice([16, 64, 512])
        sizes = [min(max(int(rng.lognormvariate(0, 1) * capacity / 5), 1), capacity) for _ in range(rng.randint(0, 400))]
        made = checked(Counter(sizes), capacity)
        assert made.sequences >= -(-sum(sizes) // capacity)
        assert made.sequences <= best_fit_falling(sizes, capacity) + 1
        alone = packing.Plan(Counter(sizes), capacity)
        alone.best_fit()
        assert alone.sequences == best_fit_falling(sizes, capacity)
    hot = checked(Counter({300: 100_000, 4096: 7, 1: 3}), 4096)
    assert hot.sequences == 7 + -(-100_000 // 13) and len(hot.rows) < 10


TEXTS = [
    None, "", " ", "one", "A  B\n\nC", "It's the WORD, isn't it?", "É é é É ß ÀÖ ǅ Σας", "x" * 3000, "日本語 text", "a\tb c d", "1234 5.6 $9!!", "<|endoftext|> <|ENDOFTEXT|>", "won't 'sword ''s 's",
    "́ a ́", "word,%%% (word).", "über.\nDie", "\n \n", "İstanbul ﬁn Å", "a'b 'S 'T d'oh",
]


def test_pieces_are_the_tokenizers_own():
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    known = LowerPieces(VOCABULARY, limit=2000)
    rng = random.Random(1)
    mixed = ["".join(rng.choice(" \n\t'.,sStTdaÉéß1日-<|") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for texts in (TEXTS[1:], mixed, mixed[::2]):
        sizes, ids = encode_column(pc.ascii_lower(pa.array(texts)), known)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert known.held < 2000 + 2000 * 800


def test_slices_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n is not None else None for n in (5, None, 30, 1, 1, 9, 2)])], names=["t"])
    got = [p.column(0).to_pylist() for p in by_bytes(iter([batch, batch.slice(2, 3)]), 0, 10)]
    assert [[len(t or "") for t in p] for p in got] == [[5, 0], [30], [1, 1], [9], [2], [30], [1, 1]]


def test_packed_documents(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "b", "Gamma,", "d e"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["same words here"] * 200 + ["long text " * 300]
    rows = [(None if i % 50 == 7 else i % 400, t, 1, 2, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, number long, length string")
    got = packing.pack(df, VOCABULARY, capacity=64).collect()
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    want = []
    for d, t, *_ in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, n, n * 64, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes())) for n, a in enumerate(range(0, len(ids), 64))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(sequences) <= best_fit_falling([w[3] for w in want], 64) + 1
    assert packing.pack(df.where("false"), VOCABULARY).count() == 0


def test_a_hot_length_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 100)
    df = spark.createDataFrame([(i % 900, i, 0, 7 if i % 3 else i % 5, i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    numbers = defaultdict(list)
    for r in packing._numbered(df).collect():
        numbers[r.length].append(r.number)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values()) and sum(map(len, numbers.values())) == 3000
