"""Stream operators run to their end over the driver's events, beside the same over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import ensure_checkpoint_dir, table
from lexiloom.streaming import queries as S

GAP = "1 hour"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'view'").withColumn("ts", F.col("ts").cast("timestamp"))


def stm1_latest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each burst of a user's views: the debounce, over the table."""
    rows = S.settled(_events(spark, sf_dir), "user_id", "event_id", gap=GAP)
    return rows.select("user_id", "event_id", F.col("at").cast("timestamp_ntz").alias("at"))


def stm5_history_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 25 pages of each user, kept by a stream over the event files."""
    folder = f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.filter("event_type = 'view'").withColumn("page", F.pmod(F.col("event_id"), F.lit(40))).select("event_id", "user_id", "page", F.col("ts").cast("timestamp").alias("ts")).repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("event_id bigint, user_id bigint, page bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    numbers: list[int] = []
    keep = S.keep_history(spark, f"{folder}/out", "user_id", "page", "ts", "event_id")

    def handle(batch: DataFrame, number: int) -> None:
        keep(batch, number)
        numbers.append(number)

    S.per_batch(stream, handle, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/v={max(numbers)}").select("user_id", "page", F.col("ts").cast("timestamp_ntz").alias("ts"))


QUERIES = {f.__name__: f for f in (stm1_latest_query, stm5_history_state)}

ORACLES = {
    "stm1_latest_query": """WITH view AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'),
cut AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM view WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
burst AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM cut)
SELECT user_id, event_id, ts AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts DESC, event_id DESC) AS r FROM burst) WHERE r = 1""",
    "stm5_history_state": """WITH view AS (SELECT user_id, event_id % 40 AS page, ts, event_id FROM events WHERE event_type = 'view'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY ts DESC, event_id DESC) AS l FROM view) WHERE l = 1)
SELECT user_id, page, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM last) WHERE p <= 25""",
}
