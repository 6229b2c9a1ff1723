"""Streaming transforms. Each takes a streaming DataFrame; ``drain`` runs one until its input is used up."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.shared import fresh_path
from quarrymill.streaming.ordered import Changes, in_order


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 20) -> DataFrame:
    """A folder or file of Parquet as a stream; the schema comes from a batch read."""
    batch = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    is_file = bool(batch.limit(1).select("_metadata.file_path").filter(F.col("file_path").endswith(f"/{name}")).head())
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def after(feed: DataFrame, order: str, seen: int) -> DataFrame:
    """The incremental feed: rows past the last sequence number that a reader has."""
    return feed.filter(F.col(order) > seen)


def timed(events: DataFrame) -> DataFrame:
    """Watermarks want instants; times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and window; rows later than ``late`` don't count."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, idle: str = "15 minutes", late: str = "60 days") -> DataFrame:
    """Activity without a break of ``idle``: the streaming twin of the stuck-job rule."""
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", idle), key).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: str, late: str = "60 days") -> DataFrame:
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def keyed(events: DataFrame, key: str, order: str, state: str, payload: str | None = None) -> DataFrame:
    """What ordered state reads: ``(key, ts, order, state, payload)``."""
    said = F.col(payload).cast("string") if payload else F.lit(None).cast("string")
    return timed(events).select(F.col(key).alias("key"), "ts", F.col(order).cast("long").alias("order"), F.col(state).alias("state"), said.alias("payload"))


def state_changes(events: DataFrame, key: str, state: str, order: str, late: str = "60 days", slot: timedelta = timedelta(days=1)) -> DataFrame:
    """Only changes of a key's state, by the rows' times and not by the files that they come in."""
    rule = Changes(events.schema[key].dataType.simpleString())
    return in_order(keyed(events, key, order, state), rule, late, slot).select(F.col("order").alias(order), F.col("key").alias(key), F.col("state").alias(state))


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State that doesn't have to fit into memory; timers and maps need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(stream: DataFrame, mode: str = "append", sink: Callable[[DataFrame], None] | None = None, end: Callable[[], None] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Run a stream over what is there and return its rows, written as Parquet in the shared folder, or feed ``sink``.

    The checkpoint, and with it the state, lies in the shared folder too. ``end`` is called once all input is read; the
    stream then goes on from its checkpoint with what that has brought (``with_end``: a row that lets all windows and slots
    close). ``by`` are columns that the files are partitioned by. In complete mode each trigger overwrites the rows.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "feed")

    def run() -> None:
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint")
        if sink is not None:
            writer = writer.foreachBatch(lambda df, _: sink(df))
        elif mode == "append":
            writer = writer.format("parquet").option("path", path).partitionBy(*by)
        else:
            writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
        writer.start().awaitTermination()

    with _state_on_disk(spark):
        run()
        if end is not None:
            end()
            run()
    if sink is not None:
        return spark.range(0).select()
    return spark.read.schema(stream.schema).parquet(path)
