"""Streaming queries, drained over whole tables; the SQL is the batch answer."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.streaming import feeds
from quarrymill.streaming.ordered import Beats, Merged, Topics, in_order, with_end

from .catalog import query, table

#: How long rows may be late, and what the ordered state of a key holds at once.
LATE, SLOT = timedelta(days=60), timedelta(days=1)
_LATE = "60 days"


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[], None]]:
    """The events as a stream, and what ends it: a time two days after the last event's day, and what rows may be late."""
    stream, end = with_end(feeds.timed(feeds.read_stream(spark, f"{sf_dir}/events.parquet")))

    def ended() -> None:
        last = table(spark, sf_dir, "events").agg(F.max("ts").alias("t")).head()["t"] or datetime(2024, 1, 1)
        end(datetime(last.year, last.month, last.day) + 3 * SLOT + LATE + timedelta(seconds=1))

    return stream, ended


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _events(spark, sf_dir)
    counted = feeds.drain(feeds.counts(events, late=_LATE), end=end)
    return counted.filter("event_type IS NOT NULL").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _events(spark, sf_dir)
    found = feeds.drain(feeds.sessions(events, "user_id"), end=end)
    return found.filter("user_id IS NOT NULL").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def stream_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _events(spark, sf_dir)
    return feeds.drain(feeds.state_changes(events, "user_id", "event_type", "event_id"), end=end)


@query("SELECT event_id, user_id FROM events WHERE event_id > 500")
def stream_log_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = feeds.after(feeds.read_stream(spark, f"{sf_dir}/events.parquet"), "event_id", 500)
    return feeds.drain(feeds.deduplicated(fresh, "event_id").select("event_id", "user_id"))


@query("""
WITH log AS (
  SELECT user_id, event_id, ts, event_type, row_number() OVER w AS n, coalesce(lead(ts) OVER w, (SELECT date_trunc('day', max(ts)) + INTERVAL 3 DAY FROM events)) AS until FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), gap AS (
  SELECT *, CASE WHEN event_type IN ('click', 'view') THEN greatest(0, (epoch_us(until) - epoch_us(ts) - 1) // 21600000000) ELSE 0 END AS beats FROM log
), before AS (
  SELECT *, n + coalesce(sum(beats) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq FROM gap
)
SELECT user_id, ts + k * INTERVAL 6 HOUR AS at, (seq + k - 1)::BIGINT AS seq, event_type AS agent FROM (SELECT *, unnest(range(1, beats + 1)) AS k FROM before)
""")
def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beat for every six silent hours of a user whose last event is a click or a view, until the stream's end."""
    events, end = _events(spark, sf_dir)
    rule = Beats("bigint", ("click", "view"), timedelta(hours=6))
    beats = feeds.drain(in_order(feeds.keyed(events, "user_id", "event_id", "event_type"), rule, _LATE, SLOT), end=end)
    return beats.select(F.col("key").alias("user_id"), F.col("at").cast("timestamp_ntz").alias("at"), "seq", F.col("state").alias("agent"))


@query("""
WITH e AS (SELECT *, lag(event_type) OVER w AS b, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS ended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), live AS (SELECT * FROM e WHERE ended IS NULL OR event_id <= ended)
SELECT 'job' AS topic, user_id, event_id, props AS message FROM live
UNION ALL SELECT 'syslog', user_id, event_id, props FROM live WHERE event_type = 'error'
UNION ALL SELECT 'status', user_id, event_id, event_type FROM live WHERE b IS NULL OR b <> event_type
UNION ALL SELECT 'job', user_id, event_id, 'done' FROM live WHERE event_id = ended
""")
def stream_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three topics, each a folder, out of one stream; a purchase is a user's end."""
    events, end = _events(spark, sf_dir)
    rule = Topics("bigint", ("error",), ("purchase",))
    told = feeds.drain(in_order(feeds.keyed(events, "user_id", "event_id", "event_type", "props"), rule, _LATE, SLOT), end=end, by=["topic"])
    return told.select("topic", F.col("key").alias("user_id"), F.col("order").alias("event_id"), "message")


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""
SELECT user_id, event_id, count(*) OVER w AS appended, {", ".join(f"last_value(CASE WHEN event_type = '{t}' THEN props END IGNORE NULLS) OVER w AS last_{t}" for t in _TYPES)}
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def stream_merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each event how many a user has and the last of each type."""
    events, end = _events(spark, sf_dir)
    merged = feeds.drain(in_order(feeds.keyed(events, "user_id", "event_id", "event_type", "props"), Merged("bigint"), _LATE, SLOT), end=end)
    return merged.select(F.col("key").alias("user_id"), F.col("order").alias("event_id"), "appended", *[F.col("fields")[t].alias(f"last_{t}") for t in _TYPES])
