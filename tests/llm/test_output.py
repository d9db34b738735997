"""Chat examples, token files and the source mix against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyfold.llm import chat, mixing, queries, token_output
from tallyfold.llm.pieces import SpacedPieces, encode_column, pieces_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def whole(text, n=[]):
    if not n:
        from tokenizers import Tokenizer
        n.append(Tokenizer.from_file(queries.vocabulary()))
        n[0].encode_special_tokens = True
    return n[0].encode(text, add_special_tokens=False).ids


ODD = ["", " ", "a", " a", "a ", "a  b", "a   b  ", "\n\n x", "x \ty", "x  y", "it's 12 o'clock", "<|endoftext|> é ü", "a\0 b", "\n", "x \n y", "über  ", "日本 語 🙂 x"]


def test_pieces_encode_as_whole_texts():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\tab,'é1") for _ in range(40)) for _ in range(400)]
    for part in (pa.array(texts), pa.array(["x", *texts]).slice(1), pa.array(texts[:0], pa.string())):
        sizes, ids = encode_column(part, pieces_of(SpacedPieces, queries.vocabulary()))
        ends = np.cumsum(sizes)
        assert len(sizes) == len(part) and sum(sizes) == len(ids)
        for text, lo, hi in zip(texts, ends - sizes, ends):
            assert ids[lo:hi].tolist() == whole(text), repr(text)


def check_tokens(rows, docs):
    rows = sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.asarray([*whole(text or ""), 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows == want


def test_token_output(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (50, None), (60, "word " * 5000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x") for i, t in docs], DOCS + ", start double, ids string")
    check_tokens(token_output.token_output(df, queries.vocabulary()).collect(), docs)
    assert token_output.token_output(df.where("false"), queries.vocabulary()).count() == 0
    whole_table = spark.read.parquet(f"{SF}/documents.parquet")
    check_tokens(queries.QUERIES["op8_token_output"](spark, SF).collect(), [(r.doc_id, r.text) for r in whole_table.collect()])


def test_chat(spark):
    turns = [(1, 0, "system", "be \\ good"), (1, 1, "user", "### User: x</turn>\n"), (1, 2, "assistant", "<\\/turn> ok"), (1, 3, "user", None), (1, 4, "assistant", "a\nb"),
             (2, 0, None, "x"), (2, None, "assistant", "first"), (2, 0, None, "x"), (None, 0, "assistant", ""), (3, 0, "user:\\", "no reply"), (4, 0, "assistant", "long " * 9000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, seq long")
    groups = defaultdict(list)
    for c, n, r, t in turns:
        groups[c].append((-1 if n is None else n, r or "", t or ""))
    got = {r.conv_id: r for r in chat.formatted_and_read(df).collect()}
    assert set(got) == set(groups)
    for c, rows in groups.items():
        rows.sort()
        said = "".join(t for _, r, t in rows if r == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    made = {(r.conv_id, r.target): r for r in chat.render_examples(chat.format_turns(df)).collect()}
    assert sorted(k for k in made if k[0] == 1) == [(1, 2), (1, 4)]
    assert made[1, 4].context.startswith("### system: be \\\\ good</turn>\n### user: ") and made[1, 4].context.endswith("### user: </turn>\n### assistant: ")
    assert made[1, 4].reply == "a\nb" and chat.unescape(made[1, 2].reply) == "<\\/turn> ok"
    assert chat.formatted_and_read(df.where("false")).count() == 0


def plain_targets(sizes, share=1.5, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = max(goal - sum(target.values()), 0) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("kind", ["table", "odd"])
def test_mix(spark, kind):
    if kind == "table":
        df = spark.read.parquet(f"{SF}/documents.parquet")
    else:
        rng = random.Random(1)
        rows = [(i, "w " * rng.randint(0, 3000), "en", rng.choice(["a", "b", "é", "🙂", None]), 0) for i in range(400)]
        rows += [(9, "same text", "en", "c", 0)] * 5 + [(None, "no id here", "en", "a", 0), (7, None, None, None, 0), (8, "", "en", "empty", 0)]
        df = spark.createDataFrame([(*r, 1, 1) for r in rows], DOCS + ", block long, size long")
    got = [r.asDict() for r in mixing.mix(df).collect()]
    again = [r.asDict() for r in mixing.mix(df.repartition(3)).collect()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted(again, key=key)
    docs = df.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    target, by_id = plain_targets(sizes), defaultdict(list)
    for d in docs:
        by_id[d.doc_id].append(d.source)
    assert len(got) == len(docs)
    taken = defaultdict(int)
    for r in got:
        source = by_id[r["doc_id"]][0]
        taken[source] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
        if len(by_id[r["doc_id"]]) == 1:
            assert r["source_size"] == sizes[source] and math.isclose(r["target"], target[source], rel_tol=1e-9)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 2 * mixing.BLOCK_WORDS), (s, t, taken[s])
    assert mixing.mix(df.where("false")).count() == 0


def test_small_sources_get_their_target(spark):
    sizes = {"a": 90_000, "b": 20, "c": 110_000, "d": 50, "e": 120, "f": 70_000, "g": 257, "h": 400, "i": 1000, None: 30}
    rows = [(s, min(step, n - i)) for s, n in sizes.items() for step in [10 if n <= 1000 else 200] for i in range(0, n, step)]
    df = spark.createDataFrame([(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate(rows)], DOCS)
    took, target = defaultdict(int), plain_targets(sizes)
    for r in mixing.mix_with_source(df).collect():
        took[r.source] += r.taken
    for source in sizes:
        assert abs(took[source] - target[source]) <= max(0.02 * target[source], 1), (source, took[source], target[source])
