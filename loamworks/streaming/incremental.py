"""Incremental work: cursors of sources, windows of a batch, file streams that take what is there and end."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import discovery, generations


def cursor_time(c: Column, now: Column, days: int = 7) -> Column:
    """A marker as a time: ISO or epoch seconds; anything else, or none, is so many days before now."""
    epoch = F.when(c.rlike(r"^\d{9,}$"), F.timestamp_seconds(c.try_cast("long")))
    return F.coalesce(epoch, F.try_to_timestamp(c), now - F.make_interval(days=F.lit(days)))


def since(df: DataFrame, cursors: DataFrame, source: str, at: str, until: Column) -> DataFrame:
    """Rows from their source's cursor (included) until a time (not included); a source without one has all rows."""
    c = cursors.select(F.col("source").alias("__s"), F.col("cursor").alias("__c"))
    return df.join(c, F.col(source) == F.col("__s"), "left").where((F.col(at) >= F.coalesce("__c", F.lit("1970-01-01").cast("timestamp"))) & (F.col(at) < until)).drop("__s", "__c")


def advanced(cursors: DataFrame, done: DataFrame) -> DataFrame:
    """source, cursor: never earlier than it was. done: source, cursor of what all stages finished."""
    return cursors.unionByName(done).groupBy("source").agg(F.max("cursor").alias("cursor"))


def in_windows(df: DataFrame, at: str, start: Column, days: int, now: Column) -> DataFrame:
    """df with batch_no (from 0), window_start, window_end: windows of so many days from start, the last one ends now."""
    seconds = days * 86_400
    n = F.floor((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(start)) / (seconds * 1_000_000)).cast("long")
    out = df.where((F.col(at) >= start) & (F.col(at) < now)).withColumn("batch_no", n)
    begin = F.timestamp_micros(F.unix_micros(start) + F.col("batch_no") * (seconds * 1_000_000))
    return out.withColumns({"window_start": begin, "window_end": F.least(now, F.timestamp_micros(F.unix_micros(begin) + seconds * 1_000_000))})


def available(spark: SparkSession, path: str, schema: StructType, each: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "parquet") -> None:
    """Take the files below path that weren't taken before, in batches; done when there are no more.

    each(batch, number) writes a batch; a batch that failed comes again with the same number, so it can write over its own.
    Two consumers with checkpoints of their own don't disturb each other.
    """
    stream = spark.readStream.schema(schema).format(kind).load(path)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def staged(spark: SparkSession, path: str, schema: StructType, stages: list[tuple[str, Callable[[DataFrame, int], None]]], base: str, checkpoint: str, at: str, kind: str = "parquet") -> None:
    """Take what is new below path in batches, each through all stages in order; its cursor moves only when all are done.

    Under base a file is left for each stage of a batch that is done, then one with the batch's latest time (column at). When a
    stage fails, the run ends with its error and the cursor stays; the next run takes the same batch again and goes on with
    that stage, so what earlier ones wrote isn't doubled. A stage that failed half-way is called again with the same number.
    """

    def each(batch: DataFrame, number: int) -> None:
        done = lambda name: f"{base}/done/{number:08d}-{name}.json"
        for name, stage in stages:
            if not discovery.exists(spark, done(name)):
                stage(batch, number)
                generations.publish(spark, done(name), json.dumps({"batch": number, "stage": name}))
        if not discovery.exists(spark, f"{base}/cursor/{number:08d}.json"):
            latest = batch.agg(F.max(F.unix_micros(F.col(at).cast("timestamp")))).first()[0]
            generations.publish(spark, f"{base}/cursor/{number:08d}.json", json.dumps({"batch": number, "micros": latest}))

    available(spark, path, schema, each, checkpoint, kind)


def cursor_of(spark: SparkSession, base: str) -> int | None:
    """The latest time (microseconds) of all batches that went through all stages under base; it never moves back."""
    if not discovery.exists(spark, f"{base}/cursor"):
        return None
    return spark.read.schema("batch long, micros long").option("pathGlobFilter", "*.json").json(f"{base}/cursor").agg(F.max("micros")).first()[0]


def windowed_counts(events: DataFrame, at: str, by: list[str], length: str, late: str) -> DataFrame:
    """Counts in tumbling windows, of a stream (rows later than the watermark are left out) or a table."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, at: str, by: list[str], gap: str) -> DataFrame:
    """Sessions of each key: a new one after a gap without a row."""
    return events.groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")
