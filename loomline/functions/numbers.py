"""Scores, sizes and cost estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: assumed price of a million input tokens in USD.
PRICE_PER_MILLION = 0.15


def tokens_rounded(size: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(size / 4).cast("long"))


def tokens_floored(size: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(size / 4).cast("long"))


def cost_per_1000_sessions(tokens: Column) -> Column:
    return F.bround(tokens * 1000 / 1_000_000 * PRICE_PER_MILLION, 6)


def reduction(tokens: Column, raw: Column) -> Column:
    """Percent saved against raw, two digits."""
    return F.bround((1 - tokens / raw) * 100, 2)


def savings(raw: Column, size: Column) -> tuple[Column, Column, Column]:
    """Saved size, ratio (null for size 0) and percent (0 for raw 0)."""
    saved = raw - size
    return saved, F.when(size != 0, raw / size), F.when(raw == 0, F.lit(0.0)).otherwise(saved / raw * 100)


def band(score: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first band, from the highest, whose bound the score reaches."""
    out = F
    for least, label in bands:
        out = out.when(score >= least, label)
    return out.otherwise(otherwise)
