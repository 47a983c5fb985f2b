"""Structured Streaming counterparts of batch behaviour: an extension, the data model itself has no streams.

File streams end with what is there (``availableNow``); the checkpoint is what makes a restart go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def severity_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by severity in tumbling windows; later than ``late`` they no longer count."""
    rows = events.withColumn("severity", tx.severity(F.col("raw")))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "severity").agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))


def first_questions(questions: DataFrame, late: str = "1 day") -> DataFrame:
    """WIN-03 on a stream: the first row of each question key within the watermark."""
    keyed = questions.withColumn("key", tx.question_key(F.col("question"))).where("key <> ''")
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is available as Parquet and stop; a later call goes on from the checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Append-and-skip of done ids: ``apply(batch, batch_id)`` for each micro-batch."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
