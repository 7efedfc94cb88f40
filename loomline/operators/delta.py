"""Delta encoding of ordered rows: what changed since the row before, and back.

`bucket` grows with the order (see neighbours), so a dataset with very many rows is encoded by many tasks. Comparison is
null-safe: an explicit null counts as a change, and missing and null are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import BUCKET, same, with_previous


def encode(df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: Column) -> DataFrame:
    """keys, order, is_origin and for each column a struct d_<column>(v), null where the value did not change."""
    rows = with_previous(df.select(*keys, *order, *columns), keys, order, columns, bucket, "_prev")
    first = F.col("_prev").isNull()
    kept = [F.when(first | ~F.col(c).eqNullSafe(F.col(f"_prev.{c}")), F.struct(F.col(c).alias("v"))).alias(f"d_{c}") for c in columns]
    return rows.select(*keys, *order, first.alias("is_origin"), *kept)


def decode(encoded: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: Column) -> DataFrame:
    """The rows behind an encoding: each column carries its last change forward."""
    rows = encoded.withColumn(BUCKET, bucket)
    at = F.struct(*order)
    ends = rows.groupBy(*keys, BUCKET).agg(*[F.max_by(f"d_{c}", F.when(F.col(f"d_{c}").isNotNull(), at)).alias(f"_e_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, BUCKET, *[F.last(f"_e_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns])
    so_far = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(*keys, *order, BUCKET, *[F.last(f"d_{c}", ignorenulls=True).over(so_far).alias(f"_l_{c}") for c in columns])
    both = same(local, carried, [*keys, BUCKET])
    return both.select(*keys, *order, *[F.coalesce(f"_l_{c}", f"_c_{c}")["v"].alias(c) for c in columns])


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of either table that the other lacks or holds with other values; none if a round trip was exact."""
    a = left.select(*keys, F.struct(*columns).alias("_a"), F.lit(1).alias("_in_a"))
    b = right.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*columns).alias("_b"), F.lit(1).alias("_in_b"))
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    differs = F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return a.join(b, on, "full").where(differs).select(*[F.coalesce(k, f"_b_{k}").alias(k) for k in keys])
