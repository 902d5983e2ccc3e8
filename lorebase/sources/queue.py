"""Message queues as folders of JSON files: a stream source, result and retry sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "message_id string, body string, retry_count int, routing_key string"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Messages in arrival order; the stream's checkpoint is the acknowledgement."""
    return (
        spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").json(folder)
        .withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))
    )


def read_batch(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MESSAGE).option("recursiveFileLookup", "true").json(folder).withColumn(
        "retry_count", F.coalesce("retry_count", F.lit(0))
    )


def publish(messages: DataFrame, folder: str, batch: int | str) -> None:
    """Append a batch below its own folder, split by routing key; a replay replaces its own output."""
    messages.write.mode("overwrite").partitionBy("routing_key").json(f"{folder}/batch={batch}")


def republish(messages: DataFrame, folder: str, batch: int | str) -> None:
    """Put failed messages back on the queue with a higher retry count."""
    again = messages.withColumn("retry_count", F.col("retry_count") + 1)
    again.select("message_id", "body", "retry_count", "routing_key").write.mode("overwrite").json(f"{folder}/retry-{batch}")
