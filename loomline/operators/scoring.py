"""Weighted scores of datasets and methods, their bands, preservation of facts, and audits of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.numbers import band, reduction, tokens_floored

#: Weights of the parts of both scores, and their bands.
TRUST_WEIGHTS = {"reconstruction": 25, "compression": 15, "continuity": 20, "noise": 15, "isolation": 15, "latency": 10}
REALISTIC_WEIGHTS = {"reconstruction": 20, "preservation": 25, "continuity": 20, "noise": 15, "isolation": 10, "latency": 10}
BANDS = [(90.0, "strong"), (75.0, "good"), (60.0, "fair"), (40.0, "weak")]


def weighted(parts: DataFrame, weights: dict[str, int], bands=BANDS) -> DataFrame:
    """Adds score (parts are shares from 0 to 1, clamped; null counts 0) and its band."""
    total = sum((F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(p).cast("double"), F.lit(0.0)))) * w for p, w in weights.items()), F.lit(0.0))
    return parts.withColumn("score", F.bround(total, 2)).withColumn("band", band(F.col("score"), bands, "failing"))


def latency_points(seconds: Column, bands: list[tuple[float, float]]) -> Column:
    """Share of the latency points by the first bound that a time keeps."""
    out = F
    for most, share in bands:
        out = out.when(seconds <= most, share)
    return out.otherwise(0.0)


def preservation(packets: DataFrame, raw: DataFrame, key: str, required: str, stale: str, packet: str, text: str) -> DataFrame:
    """Per key: required facts missing from the packet's text, stale phrases left in it, and what it saves against the raw rows.

    packets: key, packet text, arrays of required and stale phrases; raw: key and text, a row each.
    """
    held = F.lower(F.col(packet))
    sizes = raw.groupBy(key).agg(F.sum(F.length(text)).alias("raw_chars"))
    out = packets.join(sizes, key, "left").withColumns(
        {
            "n_missing": F.size(F.filter(required, lambda t: ~held.contains(F.lower(t)))).cast("long"),
            "n_stale": F.size(F.filter(stale, lambda t: held.contains(F.lower(t)))).cast("long"),
            "raw_tokens": tokens_floored(F.coalesce("raw_chars", F.lit(0))),
            "packet_tokens": tokens_floored(F.length(packet)),
        }
    )
    return out.select(key, "n_missing", "n_stale", "raw_tokens", "packet_tokens", reduction(F.col("packet_tokens"), F.col("raw_tokens")).alias("reduction"))


def answer_leaks(rows: DataFrame, truth: DataFrame, keys: list[str], text: str, values: list[str]) -> DataFrame:
    """Rows whose text holds every true value of their key: one row would give the whole answer away. Null values do not count."""
    both = rows.join(truth.select(*keys, *values), keys)
    known = [F.col(v).isNotNull() for v in values]
    held = [F.col(v).isNull() | F.contains(F.col(text), F.col(v)) for v in values]
    some, every = known[0], held[0]
    for k, h in zip(known[1:], held[1:], strict=True):
        some, every = some | k, every & h
    return both.where(some & every).select(*rows.columns)


def recount(reports: DataFrame, key: str, checks: DataFrame, passed: str, reported: str, total: str) -> DataFrame:
    """Reports whose stated numbers of passed and all checks differ from what is counted."""
    counted = checks.groupBy(key).agg(F.count_if(passed).alias("_passed"), F.count(F.lit(1)).alias("_all"))
    both = reports.join(counted, key, "left").fillna(0, ["_passed", "_all"])
    return both.where((F.col(reported) != F.col("_passed")) | (F.col(total) != F.col("_all"))).select(key, reported, total, F.col("_passed").alias("counted_passed"), F.col("_all").alias("counted_all"))
