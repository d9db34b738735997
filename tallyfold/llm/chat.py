"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it are context, only the reply itself
is trainable. The contexts of one conversation are prefixes of each other, so the output keeps the
formatted conversation once, as one segment per turn, and an example is a row of character bounds into it:
``[0, loss_start)`` is context, ``[loss_start, loss_end)`` the trainable reply. Thus a conversation of n turns takes
n segments and at most n example rows, not n² turns. ``render_examples`` writes the texts out where that is wanted.

Template: ``### Role: text</turn>`` and a newline. Control strings inside texts are broken up by a backslash and
backslashes are doubled, so a text can neither open nor close a turn, and reading back is exact.

Defined cases: a null text or role is an empty one; turns with a null number come first; rows that share a
turn number are ordered by role and text; repeated rows are repeated turns; a null ``conv_id`` is a
conversation of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import written

# The template's control strings and what stands for them inside texts: fixed values.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
_LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("###"), F.lit("#\\#\\#"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: DataFrame) -> DataFrame:
    """One segment per turn: conv_id, seq (from 0), start, segment, loss_start, loss_end (null: not trainable).

    Bounds are code points within the formatted conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    label = F.replace(escape(role), F.lit(":"), F.lit("\\:"))
    head = F.concat(F.lit(OPEN), label, F.lit(COLON))
    body = escape(text)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    made = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.length(head).alias("head"), F.length(body).alias("body"))
    placed = made.withColumn("seq", F.row_number().over(order).cast("bigint") - 1).withColumn(
        "start", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).cast("bigint"))
    trained = F.col("role") == _LOSS_ROLE
    return placed.select(
        "conv_id", "seq", "start", "segment",
        F.when(trained, F.col("start") + F.col("head")).alias("loss_start"),
        F.when(trained, F.col("start") + F.col("head") + F.col("body")).alias("loss_end"),
    )


def examples(segments: DataFrame) -> DataFrame:
    """One row per assistant turn: its number, its context and its reply as bounds into the conversation."""
    reply = segments.where(F.col("loss_start").isNotNull())
    return reply.select("conv_id", F.col("seq").alias("target"), F.lit(0).cast("bigint").alias("context_start"), F.col("loss_start").alias("context_end"), "loss_start", "loss_end")


def render_examples(segments: DataFrame) -> DataFrame:
    """The examples as texts: conv_id, target, context, reply. The output is quadratic by its nature."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, known, so_far = None, False, []
        for frame in frames:
            for conv_id, seq, start, segment, lo, hi in frame.itertuples(index=False):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if not known or conv_id != conv:
                    conv, known, so_far = conv_id, True, []
                if not pd.isna(lo):
                    head = "".join(so_far) + segment[: int(lo) - start]
                    yield pd.DataFrame({"conv_id": pd.array([conv], dtype="Int64"), "target": [seq], "context": [head], "reply": [segment[int(lo) - start:int(hi) - start]]})
                so_far.append(segment)

    ordered = segments.select("conv_id", "seq", "start", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInPandas(run, "conv_id long, target long, context string, reply string")


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: its turns, and all text under the loss mask.

    The segments of a conversation pass through one task in order, as a digest of their sequence needs; only
    the running digests are held.
    """
    mark = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None

        def row():
            return [conv, state["n"], state["turns"].hexdigest(), state["loss"], state["text"].hexdigest(), state["chars"]]

        for frame in frames:
            out = []
            for conv_id, _, start, segment, lo, hi in frame.itertuples(index=False):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if state is None or conv_id != conv:
                    if state is not None:
                        out.append(row())
                    conv, state = conv_id, {"n": 0, "turns": hashlib.sha256(), "loss": 0, "text": hashlib.sha256(), "chars": 0}
                label, body = mark.fullmatch(segment).groups()
                state["n"] += 1
                state["chars"] += len(segment)
                state["turns"].update(f"{unescape(label)}\n{unescape(body)}\n".encode())
                if not pd.isna(lo):
                    said = unescape(segment[int(lo) - start:int(hi) - start])
                    state["loss"] += len(said)
                    state["text"].update(said.encode())
            yield _frame(out)
        if state is not None:
            yield _frame([row()])

    ordered = segments.select("conv_id", "seq", "start", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return frame.astype({"conv_id": "Int64"})


def formatted_and_read(turns: DataFrame) -> DataFrame:
    """Write the segments and examples of ``turns`` to the shared folder and describe them from what was written."""
    segments = written(format_turns(turns), "chat-segments")
    targets = written(examples(segments), "chat-examples")
    # The loss mask comes from the example rows, not from the segments that they were made of.
    trained = targets.select("conv_id", F.col("target").alias("seq"), "loss_start", "loss_end")
    bare = segments.drop("loss_start", "loss_end")
    joined = bare.join(trained, bare["conv_id"].eqNullSafe(trained["conv_id"]) & (bare["seq"] == trained["seq"]), "left").select(
        bare["conv_id"], bare["seq"], "start", "segment", "loss_start", "loss_end")
    return read_back(joined)
