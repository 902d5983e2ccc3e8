"""Scans of the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a side that the planner estimates below the session's broadcast limit.

    Above the limit the side is returned as it is and the join shuffles. The estimate
    is the planner's own; the hint only settles which of two small sides is the built one.
    """
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if 0 <= size <= limit else df
