"""The same metering on unbounded streams, with Spark's own state and watermarks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, LongType, StructField, StructType

from tallyfold.session import scratch_path
from tallyfold.streaming.metering import MICRO, SLIDING_LIMIT, SLIDING_SECONDS, admit, micros

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024
SLICE_FILES = 16


class SlidingLimit(StatefulProcessor):
    """Keeps the admitted times of a key that are still inside the window."""

    def __init__(self, limit: int, window: int, expire: bool):
        self.limit, self.window, self.expire = limit, window, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.window // 1000 if self.expire else None
        self.recent = handle.getListState("recent", StructType([StructField("t", LongType())]), ttlDurationMs=ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "id"])
        recent = deque(sorted(r[0] for r in self.recent.get()))
        waits = list(admit(batch["t"].tolist(), recent, self.limit, self.window))
        if recent:
            self.recent.put([(int(t),) for t in recent])
        else:
            self.recent.clear()
        yield pd.DataFrame({"key": key[0], "id": batch["id"], "wait": pd.array(waits, dtype="Int64")})

    def close(self) -> None:
        pass


def sliding_limit_stream(
    events: DataFrame, key: str, ts: str, id_: str, limit: int = SLIDING_LIMIT, seconds: int = SLIDING_SECONDS, expire: bool = True
) -> DataFrame:
    """Streaming form of the sliding limit; rows of one key are decided in arrival batches.

    ``expire`` lets the state of silent keys go after one window of processing time. A stream that replays
    the past keeps it: there, processing time says nothing about the events.
    """
    rows = events.select(F.col(key).alias("key"), micros(F.col(ts)).alias("t"), F.col(id_).cast("bigint").alias("id"))
    kind = dict(rows.dtypes)["key"]
    decided = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=SlidingLimit(limit, seconds * MICRO, expire), outputStructType=f"key {kind}, id bigint, wait bigint",
        outputMode="Append", timeMode="ProcessingTime" if expire else "None",
    )
    return decided.select(F.col("key").alias(key), F.col("id").alias(id_), F.col("wait").isNull().alias("admitted"), F.col("wait").alias("retry_after"))


class EventTimeLimit(StatefulProcessor):
    """Decides the events of a bucket of keys in the order of their times: an event waits until the watermark has passed it.

    What waits is the keys' events of the watermark's delay, what is kept of the past the at most ``limit`` admitted times of each key's window.
    One timer per bucket stands at the earliest waiting event, or, when none waits, at the end of the last window, where the bucket's state goes.
    A call to Python and to the state serves all keys of a bucket, so their number grows with the buckets and batches, not with the keys.
    """

    def __init__(self, key: DataType, limit: int, window: int):
        self.key, self.limit, self.window = key, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key, t = StructField("key", self.key), StructField("t", LongType())
        self.recent = handle.getListState("recent", StructType([key, t]))
        self.waiting = handle.getListState("waiting", StructType([key, t, StructField("id", LongType())]))
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))

    def _wake(self, at: int) -> None:
        """The bucket's one timer, in milliseconds."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                self.waiting.appendList(list(zip(frame["key"].tolist(), frame["t"].tolist(), frame["id"].tolist())))
                low = int(frame["t"].min()) // 1000
                first = low if first is None else min(first, low)
        # A timer for the end of the window gives way to the first waiting event.
        if first is not None and (not self.timer.exists() or first < self.timer.get()[0]):
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = (timerValues.getCurrentWatermarkInMs() + 1) * 1000  # a timer at the watermark's own millisecond has fired
        self.timer.clear()
        due, rest = [], []
        for k, t, i in self.waiting.get():
            (due if t < passed else rest).append((k, t, i))
        recents: dict = {}
        for k, t in sorted(self.recent.get(), key=lambda r: r[1]):
            recents.setdefault(k, deque()).append(t)
        due.sort(key=lambda e: e[1:])
        waits = []
        for k, t, _ in due:
            waits += admit((t,), recents.setdefault(k, deque()), self.limit, self.window)
        kept = [(k, t) for k, recent in recents.items() for t in recent if t > passed - self.window]
        for state, left in ((self.recent, kept), (self.waiting, rest)):
            state.put(left) if left else state.clear()
        if rest or kept:
            self._wake(min(t for _, t, _ in rest) // 1000 if rest else (max(t for _, t in kept) + self.window) // 1000)
        if due:
            yield pd.DataFrame({"key": [k for k, _, _ in due], "id": [i for _, _, i in due], "wait": pd.array(waits, dtype="Int64")})

    def close(self) -> None:
        pass


def sliding_limit_in_time(
    events: DataFrame, key: str, ts: str, id_: str, limit: int = SLIDING_LIMIT, seconds: int = SLIDING_SECONDS, delay: str = "10 minutes",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming form whose decisions are those of the batch form, in whatever order events arrive within ``delay``.

    An event is decided once the watermark has reached its time. An event that the watermark had already reached in the batch before gets no decision and does
    not count; Spark reports how many those were in the query's progress (``numRowsDroppedByWatermark``). Keys are dealt into ``buckets`` by their hash;
    what waits of a bucket is sorted in memory when it is due, so a larger stream takes more of them.
    """
    stamped = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay)
    rows = stamped.select(F.col(key).alias("key"), "at", micros(F.col("at")).alias("t"), F.col(id_).cast("bigint").alias("id"))
    kind = dict(rows.dtypes)["key"]
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    decided = dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=EventTimeLimit(rows.schema["key"].dataType, limit, seconds * MICRO), outputStructType=f"key {kind}, id bigint, wait bigint", outputMode="Append", timeMode="EventTime")
    return decided.select(F.col("key").alias(key), F.col("id").alias(id_), F.col("wait").isNull().alias("admitted"), F.col("wait").alias("retry_after"))


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Count and sum per tumbling window; a window is final once the watermark has passed its end."""
    stamped = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay)
    series = stamped.groupBy(F.window("at", width), *by).agg(F.count("*").alias("events"), F.sum("amount").alias("amount"))
    return series.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *by, "events", "amount")


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def in_slices(df: DataFrame, number: Column, slices: int) -> DataFrame:
    """A table as a stream whose batches are the slices 0, 1, … by ``number``, each in a scattered order.

    A slice has the same number of files whatever its size, so a larger table has larger batches, not more of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "slices")
    for i in range(slices):
        df.where(number == i).repartition(SLICE_FILES, F.xxhash64(*df.columns)).write.mode("append").parquet(f"{path}/slice={i}")
    # Files are read by their age; a batch takes as many as a slice has, and more than one slice only where slices have too few rows for all files.
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(f"{path}/slice=*")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there, write the results to the shared folder and read them back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
