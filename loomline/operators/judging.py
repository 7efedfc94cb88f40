"""Judging answers against expected ones, and accuracy, size and cost of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.numbers import cost_per_1000_sessions, reduction, tokens_rounded


def judge(expected: DataFrame, answers: DataFrame, keys: list[str], fields: tuple[str, ...], wrong: str | None = None) -> DataFrame:
    """Per expected row the share of fields answered right (null-safe; a missing answer is all null), and avoidance of wrong values.

    `wrong` names an array column of expected: none of its values may stand anywhere in the answer.
    """
    mine = answers.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields])
    both = expected.join(mine, keys, "left")
    checks = [F.col(f).eqNullSafe(F.col(f"_a_{f}")) for f in fields]
    if wrong:
        said = F.concat_ws("\n", *[f"_a_{f}" for f in fields])
        checks.append(F.forall(wrong, lambda v: ~said.contains(v)))
    score = sum((c.cast("int") for c in checks), F.lit(0)) / len(checks)
    return both.select(*keys, *[c.alias(f"{f}_ok") for f, c in zip(fields, checks, strict=False)], score.alias("score"))


def total_score(judged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean score in percent, two digits."""
    return judged.groupBy(*(keys or [])).agg(F.bround(F.avg("score") * 100, 2).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def label_accuracy(truth: DataFrame, predicted: DataFrame, key: str, label: str, guarded: Column | None = None) -> DataFrame:
    """Right labels among expected ones; whether all rows of a guarded subset are right."""
    both = truth.join(predicted.select(key, F.col(label).alias("_p")), key, "left")
    right = F.coalesce(F.col(label) == F.col("_p"), F.lit(False))
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("n_right"),
        F.bround(F.count_if(right) * 100 / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("accuracy"),
        F.coalesce(F.bool_and(right | ~(guarded if guarded is not None else F.lit(True))), F.lit(True)).alias("guarded_right"),
    )


def method_costs(payloads: DataFrame, method: str, text: str, raw_method: str) -> DataFrame:
    """Characters, token estimate, cost and reduction against the raw method, of each method's payload."""
    sums = payloads.groupBy(method).agg(F.sum(F.length(text)).alias("chars")).withColumn("tokens", tokens_rounded(F.col("chars")))
    raw = sums.where(F.col(method) == raw_method).select(F.col("tokens").alias("_raw"))
    out = sums.join(F.broadcast(raw))  # one row
    return out.select(method, "chars", "tokens", cost_per_1000_sessions(F.col("tokens")).alias("usd_per_1000"), reduction(F.col("tokens"), F.col("_raw")).alias("reduction"))


def best_except(scores: DataFrame, method: str, score: str, excluded: list[str]) -> DataFrame:
    """Greatest score among methods that are not excluded."""
    return scores.agg(F.max(F.when(~F.col(method).isin(*excluded), F.col(score))).alias("best_other"))


def within(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance
