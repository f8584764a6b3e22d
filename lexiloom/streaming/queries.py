"""Streams of keystrokes and visits. Times are event times; what comes later than the watermark is left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.packs import HISTORY, history

DEBOUNCE = "120 milliseconds"


def keystrokes(spark: SparkSession, path: str, schema: str, time: str = "ts") -> DataFrame:
    """A stream over a folder of Parquet files with ``time`` as a timestamp."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def settled(events: DataFrame, user: str, text: str, time: str = "ts", gap: str = DEBOUNCE, late: str = "1 minute") -> DataFrame:
    """``(user, text, at)``: the last text of each burst of a user's keystrokes, a burst ending with a pause of ``gap``.

    Works on streams and on tables. Of keystrokes of one instant the greatest text stands.
    """
    marked = events.withWatermark(time, late) if events.isStreaming else events
    burst = marked.groupBy(user, F.session_window(time, gap))
    return burst.agg(F.max(F.struct(F.col(time).alias("at"), F.col(text).alias("text"))).alias("_l")).select(user, F.col("_l.text").alias(text), F.col("_l.at").alias("at"))


def per_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what is available batch by batch; ``handle`` gets a table, so any operator of the library may be used in it."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_history(spark: SparkSession, path: str, user: str, item: str, at: str, tie: str, size: int = HISTORY) -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps the last ``size`` items of each user in a folder of versions.

    A batch that is run again after a failure writes its own version once more and reads the one before it, so nothing
    counts twice.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.select(user, item, at, tie)
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v={number - 1}"))
        kept = history(rows, user, item, at, tie, size).join(rows.groupBy(user, item, at).agg(F.max(tie).alias(tie)), [user, item, at])
        kept.select(user, item, at, tie).write.mode("overwrite").parquet(f"{path}/v={number}")

    return handle


def answered(stream: DataFrame, rung: Callable[[DataFrame], DataFrame], sink: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that searches for the settled texts of a batch against a static pack and appends what it finds."""

    def handle(batch: DataFrame, number: int) -> None:
        rung(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return handle
