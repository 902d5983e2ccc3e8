"""Keep-first and keep-last by key.

``row_number() = 1`` is planned with a partial group limit before the shuffle, so a
key that holds a third of the rows sends at most one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keep_one(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("_n", rank).filter(F.col("_n") == 1).drop("_n")


def keep_first(df: DataFrame, key: list[str], position: str) -> DataFrame:
    return _keep_one(df, key, F.col(position).asc())


def keep_last(df: DataFrame, key: list[str], position: str) -> DataFrame:
    return _keep_one(df, key, F.col(position).desc())


def first_seen(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return df.groupBy(*key).agg(F.min(position).alias(position))
