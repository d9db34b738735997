"""Metering of the events table, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.plans.questions import cents
from tallyfold.plans.registry import Tables, query
from tallyfold.streaming import live as L
from tallyfold.streaming import metering as M

# Five events per user in six hours: a limit these events really meet.
LIMIT, SECONDS = 3, 86400


SLIDING = f"""WITH RECURSIVE o AS (
        SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (
        SELECT user_id, event_id, n, [t] AS recent, true AS admitted, CAST(NULL AS BIGINT) AS retry_after FROM o WHERE n = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.n,
            CASE WHEN len(list_filter(r.recent, lambda a: a > o.t - {SECONDS}000000)) >= {LIMIT} THEN list_filter(r.recent, lambda a: a > o.t - {SECONDS}000000)
                 ELSE list_append(list_filter(r.recent, lambda a: a > o.t - {SECONDS}000000), o.t) END,
            len(list_filter(r.recent, lambda a: a > o.t - {SECONDS}000000)) < {LIMIT},
            CASE WHEN len(list_filter(r.recent, lambda a: a > o.t - {SECONDS}000000)) >= {LIMIT}
                 THEN greatest(1, CAST(ceil((list_filter(r.recent, lambda a: a > o.t - {SECONDS}000000)[1] + {SECONDS}000000 - o.t) / 1000000.0::DOUBLE) AS BIGINT)) END
        FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id, event_id, admitted, retry_after FROM r"""


@query("sliding_limit", SLIDING)
def sliding_limit(t: Tables) -> DataFrame:
    return M.sliding_limit(t.events, "user_id", "ts", "event_id", LIMIT, SECONDS, slice_seconds=4 * SECONDS)


HOT = "CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END"


@query("sliding_limit_hot", SLIDING.replace("SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
    f"SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT event_id, ts, {HOT} AS user_id FROM events)"))
def sliding_limit_hot(t: Tables) -> DataFrame:
    """Half of all events belong to one key, which is never below its limit."""
    events = t.events.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id")))
    return M.sliding_limit(events, "user_id", "ts", "event_id", LIMIT, SECONDS, slice_seconds=SECONDS)


@query("sliding_limit_stream", SLIDING)
def sliding_limit_stream(t: Tables) -> DataFrame:
    stream = L.read_table_stream(t.spark, t.folder, "events")
    return L.drained(L.sliding_limit_stream(stream, "user_id", "ts", "event_id", LIMIT, SECONDS, expire=False), "sliding-limit")


# Batches are slices of four days; within a slice and over half a day more, events arrive in any order.
SLICE_DAYS, SLICES, SCATTER_SECONDS = 4, 9, 43200
DELAY_DAYS = 2 * SLICE_DAYS + 1


@query("sliding_limit_event_time", SLIDING.replace("SELECT user_id, event_id, admitted, retry_after FROM r", f"""SELECT user_id, event_id, admitted, retry_after
    FROM r JOIN (SELECT event_id, ts FROM events) USING (event_id) WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - {DELAY_DAYS * 86400000} FROM events)"""))
def sliding_limit_event_time(t: Tables) -> DataFrame:
    """Events that arrive out of order are decided in the order of their times; those that the watermark has not passed are still open."""
    scatter = F.pmod(F.xxhash64("event_id"), F.lit(SCATTER_SECONDS))
    first = t.events.select(F.min("ts").alias("first")).scalar()
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(first.cast("timestamp")) + scatter
    number = F.least(F.floor(arrival / (SLICE_DAYS * 86400)), F.lit(SLICES - 1))
    stream = L.in_slices(t.events.select("user_id", "ts", "event_id"), number, SLICES)
    return L.drained(L.sliding_limit_in_time(stream, "user_id", "ts", "event_id", LIMIT, SECONDS, f"{DELAY_DAYS} days"), "sliding-limit")


INSTANT = "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts FROM events"


@query("daily_budget_one_instant", f"""
    WITH e AS ({INSTANT}), n AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS n FROM e)
    SELECT event_id, day, n <= 200 AS admitted, CASE WHEN n > 200 THEN 86400 END AS retry_after FROM n""")
def daily_budget_one_instant(t: Tables) -> DataFrame:
    """Dates without a time: every day is one instant, and goes by ids that are counted in ranges."""
    return M.daily_budget(t.events.select("event_id", F.date_trunc("day", "ts").alias("ts")), "ts", "event_id", 200, keep=100)


@query("daily_budget", """
    WITH n AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id, day, n <= 200 AS admitted,
           CASE WHEN n > 200 THEN greatest(1, CAST(ceil((86400000000 - (epoch_us(ts) % 86400000000)) / 1000000.0::DOUBLE) AS BIGINT)) END AS retry_after FROM n""")
def daily_budget(t: Tables) -> DataFrame:
    return M.daily_budget(t.events.select("event_id", "ts"), "ts", "event_id", 200)


@query("daily_counts", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY 1, 2""")
def daily_counts(t: Tables) -> DataFrame:
    """Batch twin of the streaming series."""
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(
        F.count("*").alias("events"), F.sum(cents("value")).cast("double").alias("amount"))


@query("stream_daily_counts", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events
    WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def stream_daily_counts(t: Tables) -> DataFrame:
    """Final days only: the day the data ends in is still open."""
    stream = L.read_table_stream(t.spark, t.folder, "events").withColumn("amount", cents("value"))
    done = L.drained(L.windowed_counts(stream, "ts", ["event_type"]), "daily-counts")
    return done.withColumn("amount", F.col("amount").cast("double"))
