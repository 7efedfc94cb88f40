"""Positions and previous rows within a key, computed bucket by bucket.

A key that holds a large share of all rows is not gathered in one task: its rows are windowed within
(key, bucket), where `bucket` is an expression that grows with the order (a month, a range of ids), and what crosses
bucket borders comes from one small aggregated row per bucket. Null keys form a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join on equally named columns; the left side's columns stay, the right side adds its others."""
    other = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in right.columns if c not in names])
    on = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return left.join(other, on, how).drop(*[f"_r_{n}" for n in names])


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "position") -> DataFrame:
    """Adds each row's position (from 1) within keys in ascending order."""
    rows = df.withColumn(BUCKET, bucket)
    sizes = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order)))
    return same(local, before, [*keys, BUCKET]).withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", BUCKET)


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: Column, name: str = "previous") -> DataFrame:
    """Adds a struct of `columns` of the row before within keys; null on a key's first row."""
    rows = df.withColumn(BUCKET, bucket).withColumn("_own", F.struct(*columns))
    tails = rows.groupBy(*keys, BUCKET).agg(F.max_by("_own", F.struct(*order)).alias("_tail"))
    carried = tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(BUCKET))).drop("_tail")
    local = rows.withColumn("_before", F.lag("_own").over(Window.partitionBy(*keys, BUCKET).orderBy(*order)))
    return same(local, carried, [*keys, BUCKET]).withColumn(name, F.coalesce("_before", "_carry")).drop("_own", "_before", "_carry", BUCKET)
