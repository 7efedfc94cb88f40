"""Set tests and ordered unions of fields, positional joins, dates and orders by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import numbered


def is_subset(part: Column, whole: Column) -> Column:
    """Whether all elements of an array are in another; the empty array is part of any."""
    return F.size(F.array_except(part, whole)) == 0


def same_elements(left: Column, right: Column) -> Column:
    """Whether two arrays hold the same elements, whatever their order and number."""
    return is_subset(left, right) & is_subset(right, left)


def ordered_union(df: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """Each key's distinct values by where they are first seen: partial minima first, so only distinct values meet."""
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", value)))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x[value]).alias(name))


def by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], left_bucket: Column, right_bucket: Column) -> DataFrame:
    """Rows of two tables paired by their place in their own order, as far as the shorter one goes."""
    a = numbered(left, [], left_order, left_bucket, "position")
    b = numbered(right, [], right_order, right_bucket, "position")
    return a.join(b, "position")


def is_iso_day(text: Column) -> Column:
    """Whether a text is a day that exists, written YYYY-MM-DD; null is none."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.date_format(day, "yyyy-MM-dd") == text), F.lit(False))


def sort_order(mode: str, modes: dict[str, list[Column]], default: str) -> list[Column]:
    """The columns of a named order; an unknown name gives the default's."""
    return modes.get(mode, modes[default])
