"""Top rows per group and overall. Row-number limits are applied before the shuffle (window group limit), so large groups stay cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key in the given order, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def last_per_group(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The last k rows of each key; rank 1 is the newest."""
    return top_per_group(df, keys, [F.desc(c) for c in order], k)


def first_and_last(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """First k and last k rows of each key; rows that are both come twice, told apart by `part`."""
    first = top_per_group(df, keys, [F.asc(c) for c in order], k).withColumn("part", F.lit("first"))
    return first.unionByName(last_per_group(df, keys, order, k).withColumn("part", F.lit("last")))


def top_overall(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of all (kept per task before they are merged)."""
    return df.orderBy(*order).limit(k)


def best_row(df: DataFrame, keys: list[str], score: list[str], columns: list[str]) -> DataFrame:
    """The row of each key with the greatest scores, compared in turn; ties must be broken by the last of them."""
    best = F.max_by(F.struct(*columns), F.struct(*score)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in columns])
