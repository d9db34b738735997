"""Sliding limits and daily budgets over event tables, batch form."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyfold.operators.quantiles import KEPT_VALUES, value_at_rank
from tallyfold.session import stored

# ---- fixed values --------------------------------------------------------------------------------
SLIDING_LIMIT, SLIDING_SECONDS = 10, 60
DAILY_LIMIT = 2000
SLICE_WINDOWS = 64
ROUNDS = 3
FEW = 32  # events that are decided one by one
# --------------------------------------------------------------------------------------------------

MICRO = 1_000_000


def admit(times, recent: deque, limit: int, window: int):
    """Decide events in time order; ``recent`` holds the admitted times and is updated in place.

    Yields ``None`` for an admitted event, else the seconds to wait. Refused events do not count.
    """
    for t in times:
        while recent and recent[0] <= t - window:
            recent.popleft()
        if len(recent) >= limit:
            yield max(1, -(-(recent[0] + window - t) // MICRO))
        else:
            recent.append(t)
            yield None


def waits_of(times: np.ndarray, recent: deque, limit: int, window: int) -> np.ndarray:
    """``admit`` for sorted times at once, -1 for an admitted event: a stretch of refused events is one step, however many there are."""
    waits, i, n = np.full(len(times), -1, np.int64), 0, len(times)
    while i < n:
        t = int(times[i])
        while recent and recent[0] <= t - window:
            recent.popleft()
        if len(recent) < limit:
            recent.append(t)
            i += 1
            continue
        until = recent[0] + window
        # Most stretches are short; only beyond a few events is the rest searched.
        j = i + 1
        while j < n and j < i + 8 and times[j] < until:
            j += 1
        if j == i + 8:
            j += int(np.searchsorted(times[j:], until))
        waits[i:j] = np.maximum(1, -((times[i:j] - until) // MICRO))
        i = j
    return waits


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _decided(rows: DataFrame, by: list[str], limit: int, window: int, decisions: bool) -> DataFrame:
    """Every group of ``by`` in time order, starting from its entry state: decisions per event, or each group's exit state.

    Rows are sorted within their partition and pass through a task as a stream; what is held is one batch and the at most ``limit`` admitted
    times of the group at hand, however many rows the group has. ``rows`` has key, slice, t, id and entry.
    """
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, slice bigint, " + ("id bigint, wait bigint" if decisions else "exit array<bigint>")
    width = len(by)

    def run(frames):
        group, recent = None, deque()
        for frame in frames:
            if not len(frame):
                continue
            exits, times = [], frame["t"].to_numpy()
            new = np.zeros(len(frame), bool)
            new[0] = True
            for c in by:
                new |= (frame[c] != frame[c].shift()).to_numpy() & ~(frame[c].isna() & frame[c].shift().isna()).to_numpy()
            starts = np.flatnonzero(new | (np.arange(len(frame)) == 0))
            waits, listed = np.empty(len(frame), np.int64), times.tolist()
            heads = zip(*(frame[c].iloc[starts] for c in ("key", "slice", "entry")))
            for (*row, entry), a, b in zip(heads, starts.tolist(), [*starts[1:].tolist(), len(frame)]):
                if tuple(row[:width]) != group:
                    if group is not None:
                        exits.append((*group, list(recent)))
                    group, recent = tuple(row[:width]), deque(sorted(entry) if entry is not None else ())
                if b - a <= FEW:
                    waits[a:b] = [-1 if w is None else w for w in admit(listed[a:b], recent, limit, window)]
                else:
                    waits[a:b] = waits_of(times[a:b], recent, limit, window)
            if decisions:
                yield pd.DataFrame({"key": frame["key"], "slice": frame["slice"], "id": frame["id"], "wait": pd.arrays.IntegerArray(waits, waits < 0)})
            elif exits:
                yield pd.DataFrame(exits, columns=["key", "slice", "exit"])
        if not decisions and group is not None:
            yield pd.DataFrame([(*group, list(recent))], columns=["key", "slice", "exit"])

    ordered = rows.select("key", "slice", "t", "id", "entry").repartition(*by).sortWithinPartitions(*by, "t", "id")
    return ordered.mapInPandas(run, schema)


def sliding_limit(
    events: DataFrame, key: str, ts: str, id_: str, limit: int = SLIDING_LIMIT, seconds: int = SLIDING_SECONDS, slice_seconds: int | None = None
) -> DataFrame:
    """``(key, id, admitted, retry_after)``: at most ``limit`` admitted events per key in any ``(t − window, t]``.

    Which events are admitted depends on the ones admitted before, so a key looks sequential. It is cut
    into time slices of at least one window: a slice depends on the one before it only through the last
    few admitted times. All slices are decided at once as if each started empty; then only the slices
    whose entry turns out different are decided again. A slice of many windows mostly forgets its entry before it ends, so a
    few rounds are enough for most keys. Keys that are saturated without a pause do not forget: those that still
    change after ``ROUNDS`` rounds are decided from their first event on, each as one sorted stream with ``limit`` times of state.
    """
    window = seconds * MICRO
    width = max(slice_seconds or SLICE_WINDOWS * seconds, seconds) * MICRO
    rows = events.select(F.col(key).alias("key"), micros(F.col(ts)).alias("t"), F.col(id_).cast("bigint").alias("id"))
    rows = rows.withColumn("slice", F.floor(F.col("t") / width))
    keys, none = ["key", "slice"], F.lit(None).cast("array<bigint>")

    exits = stored(_decided(rows.withColumn("entry", none), keys, limit, window, False), "meter-exits")
    used = exits.select(*keys, F.array().cast("array<bigint>").alias("entry"))
    changed = None
    for _ in range(ROUNDS + 1):
        # What is still in the window when the next slice starts.
        after = exits.withColumn("next", F.col("slice") + 1).withColumn("open_from", F.col("next") * width - window)
        carried = after.withColumn("entry", F.filter("exit", lambda a: a > F.col("open_from"))).select(
            "key", F.col("next").alias("slice"), "entry"
        )
        entry = exits.select(*keys).join(carried, keys, "left").select(*keys, F.coalesce("entry", F.array().cast("array<bigint>")).alias("entry"))
        changed = stored(entry.join(used.withColumnRenamed("entry", "old"), keys).filter(F.col("entry") != F.col("old")).drop("old"), "meter-changed")
        if changed.isEmpty():
            break
        again = _decided(rows.join(changed, keys), keys, limit, window, False)
        exits = stored(exits.join(changed.select(*keys), keys, "left_anti").unionByName(again), "meter-exits")
        used = stored(used.join(changed.select(*keys), keys, "left_anti").unionByName(changed), "meter-used")
    # Empty after the last round, unless some keys go on changing.
    saturated = stored(changed.select("key").distinct(), "meter-saturated")
    settled_rows = rows.join(saturated, "key", "left_anti").join(used, keys)
    in_one = rows.join(saturated, "key", "left_semi").withColumn("entry", none)
    decided = _decided(settled_rows, keys, limit, window, True).unionByName(_decided(in_one, ["key"], limit, window, True))
    return decided.select(F.col("key").alias(key), F.col("id").alias(id_), F.col("wait").isNull().alias("admitted"), F.col("wait").alias("retry_after"))


def seconds_to_midnight(ts: Column) -> Column:
    """Until the next UTC midnight, at least one second."""
    day = 86400 * MICRO
    return F.greatest(F.lit(1), F.ceil((day - micros(ts) % day) / MICRO)).cast("bigint")


def daily_budget(events: DataFrame, ts: str, id_: str, limit: int = DAILY_LIMIT, keep: int = KEPT_VALUES) -> DataFrame:
    """``(id, day, admitted, retry_after)``: the first ``limit`` events of each UTC day are admitted.

    The rows of a day are never numbered as a whole. Counts per minute tell in which minute the limit falls, counts per
    second and per instant where within it. Events of that one instant go by id: the last admitted id is found by counts of id ranges, so a
    day whose events all have one instant (dates without a time) is decided in many tasks too. All events are then compared with one row per day.
    """
    when, id_col = F.col(ts), F.col(id_)
    steps = {"minute": F.hour(when) * 60 + F.minute(when), "second": F.second(when.cast("timestamp")).cast("int"), "instant": micros(when)}
    rows = events.withColumn("day", when.cast("date"))
    crossing, keys = None, ["day"]
    for step, place in steps.items():
        part = rows if crossing is None else rows.join(crossing, keys)
        left = F.lit(limit).cast("bigint") if crossing is None else F.col("left")
        counted = part.withColumn(step, place).groupBy(*keys, step, left.alias("still")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("day").orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("still")) & (F.col("upto") - F.col("n") < F.col("still")))
        keys = [*keys, step]
        crossing = stored(found.select(*keys, (F.col("still") - F.col("upto") + F.col("n")).alias("left")), f"budget-{step}")
        rows = rows.withColumn(step, place)
    inside = rows.join(crossing, keys)
    if isinstance(events.schema[id_].dataType, NumericType):
        ranks = crossing.select("day", (F.col("left") - 1).alias("rank"))
        last = value_at_rank(inside.select("day", id_col.alias("last")), ["day"], "last", ranks, keep)
    else:
        numbered = inside.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy(id_col)))
        last = numbered.filter(F.col("n") == F.col("left")).select("day", id_col.alias("last"))
    cut = stored(last.join(crossing, "day").select("day", F.col("instant").alias("until"), "last"), "budget-cut")
    at = micros(when)
    within = F.col("until").isNull() | (at < F.col("until")) | ((at == F.col("until")) & (id_col <= F.col("last")))
    marked = events.withColumn("day", when.cast("date")).join(cut, "day", "left").withColumn("admitted", within)
    return marked.select(id_col, "day", "admitted", F.when(~F.col("admitted"), seconds_to_midnight(when)).alias("retry_after"))
