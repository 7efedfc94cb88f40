"""Encoded forms of datasets and the way back: raw, transform, dictionary and rule form of the long form of rules.py.

Every form is a table that holds only what it needs; decode() goes by the form's name. Nothing is gathered: the transform form carries values
forward bucket by bucket (see neighbours), the dictionary form joins its codes with its values, the rule form is generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules
from .delta import mismatches
from .encoding import BUCKET_ROWS, MODES, dictionary_columns
from .neighbours import BUCKET, same, with_previous

KEYS = ["dataset", "field"]
CELL = [*KEYS, "idx", "text"]


def encode(cells: DataFrame, mode: str) -> dict[str, DataFrame]:
    """The tables of a form. rule: datasets whose fields all follow rules; the others have no rows there."""
    if mode == "raw":
        return {"rows": cells.select(*CELL)}
    if mode == "transform":
        rows = with_previous(cells.select(*CELL), KEYS, ["idx"], ["text"], F.floor(F.col("idx") / BUCKET_ROWS), "_prev")
        changed = F.col("_prev").isNull() | ~F.col("text").eqNullSafe(F.col("_prev.text"))
        sizes = cells.groupBy(*KEYS).agg((F.max("idx") + 1).alias("n"))
        return {"changes": rows.where(changed).select(*CELL), "sizes": sizes}
    if mode == "dictionary":
        codes = dictionary_columns(cells).select(*KEYS, "text", F.col("code").cast("long").alias("code"))
        return {"values": codes, "codes": same(cells.select(*CELL), codes, [*KEYS, "text"]).select(*KEYS, "idx", "code")}
    if mode == "rule":
        found = rules.discover(cells)
        whole = found.groupBy("dataset").agg(F.bool_and(F.col("type").isNotNull()).alias("_ok")).where("_ok").drop("_ok")
        return {"rules": found.join(whole, "dataset", "left_semi")}
    raise ValueError(f"unknown form: {mode}")


def decode(mode: str, form: dict[str, DataFrame]) -> DataFrame:
    """(dataset, field, idx, text) behind a form; a name that is no form's is an error."""
    if mode == "raw":
        return form["rows"].select(*CELL)
    if mode == "transform":
        return _carried(form["changes"], form["sizes"])
    if mode == "dictionary":
        return form["codes"].join(form["values"], [*KEYS, "code"]).select(*CELL)
    if mode == "rule":
        return rules.values(form["rules"])
    raise ValueError(f"unknown form: {mode}")


def _carried(changes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each change stands for the rows up to the next one; the next one across a bucket's border comes from one row per bucket."""
    bucket = F.floor(F.col("idx") / BUCKET_ROWS)
    rows = changes.withColumn(BUCKET, bucket)
    heads = rows.groupBy(*KEYS, BUCKET).agg(F.min("idx").alias("_first"))
    later = heads.withColumn("_after", F.lead("_first").over(Window.partitionBy(*KEYS).orderBy(BUCKET))).drop("_first")
    local = rows.withColumn("_next", F.lead("idx").over(Window.partitionBy(*KEYS, BUCKET).orderBy("idx")))
    runs = same(same(local, later, [*KEYS, BUCKET]), sizes, KEYS)
    stop = F.coalesce("_next", "_after", "n")
    return runs.select(*KEYS, F.explode(F.sequence(F.col("idx"), stop - 1)).alias("idx"), "text").select(*CELL)


def round_trips(cells: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """dataset, mode, mismatches and exact, for every form that a dataset has."""
    out = None
    for mode in modes:
        form = encode(cells, mode)
        own = cells.select(*CELL) if mode != "rule" else cells.join(form["rules"].select("dataset").distinct(), "dataset", "left_semi").select(*CELL)
        wrong = mismatches(own, decode(mode, form), [*KEYS, "idx"], ["text"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("mismatches"))
        datasets = own.select("dataset").distinct()
        n = F.coalesce("mismatches", F.lit(0))
        rows = datasets.join(wrong, "dataset", "left").select("dataset", F.lit(mode).alias("mode"), n.alias("mismatches"), (n == 0).alias("exact"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mode_of(tag: Column, modes: tuple[str, ...] = MODES) -> Column:
    """The tag if it is a form's name; any other is an error when the row is read."""
    return F.when(tag.isin(*modes), tag).otherwise(F.raise_error(F.concat(F.lit("unknown form: "), F.coalesce(tag, F.lit("null")))))


#: The classes of decisions, in the order in which they are tried.
CLASSES = (
    ("noise kept raw", "correct", "policy correctly cautious"),
    ("noise not kept raw", "needs_review", "policy may be too aggressive"),
    ("dictionary or rule", "correct", "real engine improvement"),
    ("transform", "acceptable_but_suboptimal", "old scoring/engine limitation"),
    ("raw", "safe_but_cautious", "policy cautious"),
    ("other", "needs_review", "unknown"),
)


def decision_class(noisy: Column, mode: Column, saved_percent: Column, ratio: Column) -> Column:
    """A struct (correctness, classification) of a policy's decision."""
    saved, times = F.coalesce(saved_percent, F.lit(0.0)), F.coalesce(ratio, F.lit(1.0))
    large = (saved >= 50) & (times >= 2)
    tests = (noisy & (mode == "raw") & (saved == 0), noisy, mode.isin("dictionary", "rule") & large, (mode == "transform") & (saved >= 10), mode == "raw")
    told = [F.struct(F.lit(c).alias("correctness"), F.lit(k).alias("classification")) for _, c, k in CLASSES]
    out = F.when(tests[0], told[0])
    for test, value in zip(tests[1:], told[1:], strict=False):
        out = out.when(test, value)
    return out.otherwise(told[-1])
