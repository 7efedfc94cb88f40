"""Choice of an encoding for each dataset: sizes of raw, delta, dictionary and rule form as compact JSON, and the policy.

Input is the long form of rules.py. Sizes are sums over rows, so a dataset is measured without ever being gathered; texts
count as ASCII-only JSON strings. Fields come in a stated order, the same for all rows of a dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.numbers import savings
from loomline.functions.text import any_of, json_string_size, once

from loomline.sources.shared import written

from . import rules
from .neighbours import BUCKET, numbered

#: Rows of one bucket when a column's rows are compared in order.
BUCKET_ROWS = 100_000
#: Ends of buckets that are broadcast.
ENDS_SENT = 100_000
#: Percent that an encoding must save to be chosen.
MINIMUM_SAVINGS = 10.0
#: Words of noise texts and importances of noise rows.
NOISE_WORDS = ["noise", "filler", "random", "irrelevant", "duplicate"]
LOW_IMPORTANCE = ("none", "low", "noise")
MODES = ("raw", "transform", "dictionary", "rule")


def cell_size(text: Column, is_int: Column) -> Column:
    return F.when(text.isNull(), F.lit(4)).when(is_int, F.length(text)).otherwise(json_string_size(text)).cast("long")


def _bucket() -> Column:
    return F.floor(F.col("idx") / BUCKET_ROWS)


def as_rows(cells: DataFrame) -> DataFrame:
    """The wide form of rules.py of long cells: (dataset, idx, cells)."""
    return cells.groupBy("dataset", "idx").agg(F.array_sort(F.collect_list(F.struct("field", "text", "is_int"))).alias("cells"))


def with_pairs(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Adds `pairs`, the sizes of a row's names and values with the marks between; cheaper where the fields of all rows are given."""
    pair = lambda c, f: (json_string_size(f) + 1 + cell_size(c["text"], c["is_int"])).cast("int")
    if fields is None:
        return rows.withColumn("pairs", F.transform("cells", lambda c: pair(c, c["field"])))
    return rows.withColumn("pairs", F.array(*[pair(F.get("cells", F.lit(i)), F.lit(f)) for i, f in enumerate(fields)]))


def _with_ends_before(rows: DataFrame) -> DataFrame:
    """rows with their bucket, and the last row before each bucket once more in that bucket, marked `ahead`; found by the buckets' last places."""
    rows = rows.withColumn(BUCKET, _bucket())
    ends = rows.groupBy("dataset", BUCKET).agg(F.max("idx").alias("idx"))
    after = F.lead(BUCKET).over(Window.partitionBy("dataset").orderBy(BUCKET))
    ends = written(ends.select("dataset", "idx", after.alias("_after")).where("_after IS NOT NULL"), "ends")
    sent = F.broadcast(ends) if ends.count() <= ENDS_SENT else ends
    ahead = rows.drop(BUCKET).join(sent, ["dataset", "idx"]).withColumnRenamed("_after", BUCKET)
    return rows.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True)))


def row_form_sizes(cells: DataFrame) -> DataFrame:
    """dataset, n, raw_size and transform_size."""
    return wide_form_sizes(as_rows(cells))


def wide_form_sizes(rows: DataFrame) -> DataFrame:
    """The same of wide rows: one shuffle of whole rows by bucket, in which each row meets the one before."""
    rows = rows if "pairs" in rows.columns else with_pairs(rows)
    by_bucket = _with_ends_before(rows.select("dataset", "idx", "pairs", F.col("cells.text").alias("own"))).repartition("dataset", BUCKET)
    before = F.lag("own").over(Window.partitionBy("dataset", BUCKET).orderBy("idx"))
    seen = by_bucket.withColumn("before", before).where(~F.col("ahead"))
    # the pairs that are new, the others as null
    changed = F.zip_with("own", "before", lambda a, b: ~a.eqNullSafe(b))
    new = F.when(F.col("before").isNull(), F.col("pairs")).otherwise(F.zip_with("pairs", changed, lambda p, c: F.when(c, p)))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    both = once(once(seen, new=F.array_compact(new)), all=total(F.col("pairs")), some=total(F.col("new")))
    row, delta = F.col("all") + F.size("own") + 1, F.col("some") + F.greatest(F.size("new") - 1, F.lit(0)) + 2
    sums = both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("rows"), F.sum(F.when(F.col("idx") == 0, row).otherwise(delta)).alias("deltas"))
    fixed = len('{"m":"transform","o":,"d":[]}')
    return sums.select("dataset", "n", (F.col("rows") + F.col("n") + 1).alias("raw_size"), (F.col("deltas") + F.greatest(F.col("n") - 2, F.lit(0)) + fixed).alias("transform_size"))


def distinct_values(cells: DataFrame) -> DataFrame:
    """(dataset, field, text, idx, last, uses, is_int): each column's distinct values, where they are seen first and last."""
    return cells.groupBy("dataset", "field", "text").agg(F.min("idx").alias("idx"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("uses"), F.bool_and("is_int").alias("is_int"))


def coded(found: DataFrame) -> DataFrame:
    """Distinct values with codes in order of first sight, and their sizes. found is read twice."""
    out = numbered(found, ["dataset", "field"], ["idx"], _bucket(), "code").withColumn("code", F.col("code") - 1)
    return out.withColumns({"size": cell_size(F.col("text"), F.col("is_int")), "key_size": json_string_size(F.col("field")).cast("long") + 1})


def dictionary_columns(cells: DataFrame) -> DataFrame:
    """(dataset, field, text, code, uses, size): each column's distinct values with codes in order of first sight."""
    return coded(distinct_values(cells))


def dictionary_sizes(cells: DataFrame) -> DataFrame:
    """dataset, dictionary_size."""
    return coded_sizes(coded(distinct_values(cells)))


def coded_sizes(codes: DataFrame) -> DataFrame:
    column = codes.groupBy("dataset", "field").agg(
        F.sum("uses").alias("n"), F.count(F.lit(1)).alias("u"), F.sum("size").alias("distinct"), F.sum(F.col("size") * F.col("uses")).alias("all"), F.sum(F.length(F.col("code").cast("string")) * F.col("uses")).alias("codes"), F.first("key_size").alias("key_size")
    )
    coded = F.col("distinct") + F.col("u") - 1 + F.col("codes") + F.col("n") - 1 + len('{"t":"dict","v":[],"i":[]}')
    plain = F.col("all") + F.col("n") - 1 + len('{"t":"raw","v":[]}')
    own = F.col("key_size") + F.when(F.col("u") < F.col("n"), coded).otherwise(plain)
    total = column.groupBy("dataset").agg(F.sum(own + F.col("key_size") - 1).alias("s"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    fixed = len('{"m":"dictionary","n":,"o":[],"c":{}}')
    return total.select("dataset", (F.col("s") + 2 * (F.col("k") - 1) + F.length(F.col("n").cast("string")) + fixed).alias("dictionary_size"))


def rule_sizes(found: DataFrame, ints: DataFrame, field_order: dict[str, int]) -> DataFrame:
    """dataset, rule_possible, failed_field and rule_size (null if not all fields follow rules); ints: dataset, field, is_int."""
    json = lambda c, i: cell_size(c, i)
    n = lambda c: F.length(c.cast("string"))
    is_int = F.col("is_int")
    cycle = F.aggregate(F.transform("cycle", lambda x: json(x, is_int)), F.lit(0).cast("long"), lambda a, x: a + x) + F.size("cycle") - 1
    body = (
        F.when(F.col("type") == "constant", json(F.col("value"), is_int) + len('{"rule_found":true,"type":"constant","value":}'))
        .when(F.col("type") == "linear", n(F.col("base")) + n(F.col("step")) + len('{"rule_found":true,"type":"linear","base":,"step":}'))
        .when(F.col("type") == "cycle", cycle + n(F.size("cycle")) + len('{"rule_found":true,"type":"cycle","cycle":[],"cycle_length":}'))
        .when(
            F.col("type") == "template",
            json_string_size(F.col("prefix")) + json_string_size(F.col("suffix")) + n(F.col("base")) + n(F.col("step")) + F.coalesce(n(F.col("width")), F.lit(4))
            + len('{"rule_found":true,"type":"string_numeric_template","prefix":,"suffix":,"base":,"step":,"width":,"reason":"Symbolic numeric template rule discovered"}'),
        )
    )
    sized = found.join(ints, ["dataset", "field"]).withColumn("_s", body + json_string_size(F.col("field")) + 1)
    total = sized.groupBy("dataset").agg(F.sum("_s").alias("s"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.bool_and(F.col("type").isNotNull()).alias("ok"))
    size = F.col("s") + F.col("k") - 1 + n(F.col("n")) + len('{"m":"rule","n":,"r":{}}')
    return rules.dataset_verdict(found, field_order).join(total.select("dataset", F.when(F.col("ok"), size).alias("rule_size")), "dataset")


def noise_guardrail(found: DataFrame, importance: str = "importance") -> DataFrame:
    """dataset, noise: 25 rows or more, nearly all of low importance, with noise words or nearly all texts different. found: distinct_values()."""
    low, uses, is_text = F.lower(F.col("text")), F.col("uses"), ~F.col("is_int") & F.col("text").isNotNull()
    per_value = found.groupBy("dataset", F.when(is_text, F.col("text")).alias("value")).agg(
        F.max("last").alias("last"),
        F.sum(F.when(is_text, uses).otherwise(0)).alias("texts"),
        F.sum(F.when((F.col("field") == importance) & low.isin(*LOW_IMPORTANCE), uses).otherwise(0)).alias("low"),
        F.sum(F.when(is_text & any_of(low, NOISE_WORDS), uses).otherwise(0)).alias("noisy"),
    )
    sums = per_value.groupBy("dataset").agg((F.max("last") + 1).alias("n"), F.sum("texts").alias("texts"), F.count("value").alias("different"), F.sum("low").alias("low"), F.sum("noisy").alias("noisy"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    verdict = (F.col("n") >= 25) & (F.col("texts") > 0) & ((share("low", "n") >= 0.8) & (share("noisy", "texts") >= 0.5) | (share("low", "n") >= 0.9) & (share("different", "texts") >= 0.7))
    return sums.select("dataset", verdict.alias("noise"))


def decide(cells: DataFrame, field_order: dict[str, int], minimum: float = MINIMUM_SAVINGS) -> DataFrame:
    """One row per dataset: the four sizes, the smallest mode, and the mode that the policy takes with its reason."""
    return decide_rows(as_rows(cells), field_order, minimum)


def decide_rows(rows: DataFrame, field_order: dict[str, int], minimum: float = MINIMUM_SAVINGS) -> DataFrame:
    """decide() of the wide form of rules.py, which needs no shuffle to see whole rows."""
    rows = written(rows if "pairs" in rows.columns else with_pairs(rows), "rows")
    cells = rules.cells_of(rows)
    rule, found = written(rules.discover(cells), "rules"), written(distinct_values(cells), "values")
    ints = found.groupBy("dataset", "field").agg(F.bool_and("is_int").alias("is_int"))
    sizes = wide_form_sizes(rows).join(coded_sizes(coded(found)), "dataset").join(rule_sizes(rule, ints, field_order), "dataset").join(noise_guardrail(found), "dataset")
    options = F.array(*[F.struct(F.col(f"{m}_size").alias("size"), F.lit(i).alias("rank"), F.lit(m).alias("mode")) for i, m in enumerate(MODES)])
    best = F.array_min(F.filter(options, lambda o: o["size"].isNotNull()))
    rows = sizes.withColumn("best", best)
    _, _, percent = savings(F.col("raw_size"), F.col("best.size"))
    rows = rows.withColumn("percent", percent)
    reason = F.when(F.col("noise"), "noise").when(F.col("best.mode") == "raw", "raw is smallest").when(F.col("percent") < minimum, "saves too little").otherwise("saves enough")
    rows = rows.withColumn("reason", reason).withColumn("policy_mode", F.when(F.col("reason") == "saves enough", F.col("best.mode")).otherwise("raw"))
    size = F.element_at(F.create_map(*[x for m in MODES for x in (F.lit(m), F.col(f"{m}_size"))]), F.col("policy_mode"))
    return rows.select(
        "dataset", "n", "raw_size", "transform_size", "dictionary_size", "rule_possible", "failed_field", "rule_size",
        F.col("best.mode").alias("best_mode"), F.col("best.size").alias("best_size"), F.bround("percent", 2).alias("saved_percent"), "noise", "policy_mode", size.alias("policy_size"), "reason",
    )
