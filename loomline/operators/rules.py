"""Discovery of column rules: constant, linear, cyclic and numbered-text columns, and the values behind a rule.

Input is long: (dataset, field, idx, text, is_int), idx counting a dataset's rows from 0. The first HEAD values of a
column fix every rule it could follow, so candidates are made from that bounded head. Columns whose head already breaks all of them are done;
each row of the others checks itself against the candidates, and the checks are combined by AND before the shuffle. No task ever holds a whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import once
from loomline.sources.shared import written

MAX_CYCLE, MIN_REPEATS = 20, 2
HEAD = MIN_REPEATS * MAX_CYCLE
#: Columns whose heads are broadcast (some tens of MB); with more of them, each is small beside all.
HEADS_SENT = 10_000
#: Fixed value: text before, within and after the first integer of a value.
TEMPLATE = r"^(.*?)(-?[0-9]+)(.*)$"


def wide_form(df: DataFrame, dataset: Column, idx: Column, fields: list[str]) -> DataFrame:
    """One row per row: its values in the order of the fields; whole numbers are marked, as only they can be linear."""
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text"), F.lit(kinds[f] in ("tinyint", "smallint", "int", "bigint")).alias("is_int")) for f in fields]
    return df.select(dataset.alias("dataset"), idx.cast("long").alias("idx"), F.array(*cells).alias("cells"))


def cells_of(rows: DataFrame) -> DataFrame:
    """The long form of a wide one."""
    return rows.select("dataset", "idx", F.inline("cells"))


def long_form(df: DataFrame, dataset: Column, idx: Column, fields: list[str]) -> DataFrame:
    """One row per value."""
    return cells_of(wide_form(df, dataset, idx, fields))


def _heads(cells: DataFrame) -> DataFrame:
    first = F.array_sort(F.collect_list(F.when(F.col("idx") < HEAD, F.struct("idx", "text"))))
    return cells.groupBy("dataset", "field").agg(F.count(F.lit(1)).alias("n"), first.alias("first"), F.bool_and("is_int").alias("ints")).select(
        "dataset", "field", "n", "ints", "first", F.transform("first", lambda x: x["text"]).alias("head")
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, TEMPLATE, 2), "-", "")


def _number(text: Column) -> Column:
    return text.try_cast("bigint")


def numbered_text(prefix: Column, value: Column, width: Column, suffix: Column) -> Column:
    """prefix, the number (zero-filled to width if there is one) and suffix."""
    plain = F.abs(value).cast("string")
    digits = F.when(width.isNotNull() & (F.length(plain) < width), F.lpad(plain, width, F.lit("0"))).otherwise(plain)
    return F.concat(prefix, F.when(value < 0, "-").otherwise(""), digits, suffix)


def discover(cells: DataFrame, max_cycle: int = MAX_CYCLE, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """dataset, field, n, type (null if the column follows no rule) and the rule's parts, of every column."""
    heads = _heads(cells).withColumns(
        {
            "base": _number(F.get("head", F.lit(0))),
            "step": _number(F.get("head", F.lit(1))) - _number(F.get("head", F.lit(0))),
            "prefix": F.regexp_extract(F.get("head", F.lit(0)), TEMPLATE, 1),
            "suffix": F.regexp_extract(F.get("head", F.lit(0)), TEMPLATE, 3),
            "t_base": _number(F.regexp_extract(F.get("head", F.lit(0)), TEMPLATE, 2)),
            "t_step": _number(F.regexp_extract(F.get("head", F.lit(1)), TEMPLATE, 2)) - _number(F.regexp_extract(F.get("head", F.lit(0)), TEMPLATE, 2)),
        }
    )
    # a column of digits of one length has that of its first value
    heads = heads.withColumn("t_width", F.length(_digits(F.get("head", F.lit(0)))))
    in_head = lambda test: F.forall("first", lambda x: test(x["idx"], x["text"]))
    linear = lambda i, text: _number(text).eqNullSafe(F.col("base") + F.col("step") * i)
    value = lambda i: F.col("t_base") + F.col("t_step") * i
    plain = lambda i, text: text.eqNullSafe(numbered_text(F.col("prefix"), value(i), F.lit(None).cast("int"), F.col("suffix")))
    filled = lambda i, text: text.eqNullSafe(numbered_text(F.col("prefix"), value(i), F.col("t_width"), F.col("suffix")))
    cyclic = lambda p: lambda i, text: text.eqNullSafe(F.get("head", (i % p).cast("int")))
    numbers = ~F.col("ints") & (F.col("t_step") != 0)
    periods = F.array_compact(F.array(*[F.when((F.col("n") >= max(4, p * min_repeats)) & in_head(cyclic(p)), F.lit(p)) for p in range(1, max_cycle + 1)]))
    heads = heads.withColumns(
        {
            "may_constant": in_head(cyclic(1)),
            "may_linear": F.coalesce(F.col("ints") & in_head(linear), F.lit(False)),
            "may_template": F.coalesce(numbers & (in_head(plain) | in_head(filled)), F.lit(False)),
            "periods": periods,
        }
    )
    heads = written(heads.drop("first"), "heads")
    open_ = heads.where(F.col("may_constant") | F.col("may_linear") | F.col("may_template") | (F.size("periods") > 0)).drop("n", "ints")
    # one row of at most HEAD values per column: sent to all tasks while there are few, so that no column is gathered
    sent = F.broadcast(open_) if open_.count() <= HEADS_SENT else open_
    own = cells.select("dataset", "field", "idx", "text").join(sent, ["dataset", "field"])
    i, text = F.col("idx"), F.col("text")
    made = F.when(F.col("may_template"), F.struct(plain(i, text).alias("plain"), filled(i, text).alias("filled")))
    own = once(own, made=made)
    digits = F.when(F.col("made.plain") | F.col("made.filled"), _digits(text))
    own = once(own, digits=digits)
    cycles = [F.bool_and(F.when(F.array_contains("periods", p), cyclic(p)(i, text))).alias(f"c{p}") for p in range(1, max_cycle + 1)]
    checked = own.groupBy("dataset", "field").agg(
        F.bool_and(F.when(F.col("may_constant"), cyclic(1)(i, text))).alias("constant"),
        F.bool_and(F.when(F.col("may_linear"), linear(i, text))).alias("linear"),
        F.bool_and("made.plain").alias("plain"),
        F.bool_and("made.filled").alias("filled"),
        F.min(F.length("digits")).alias("width"),
        F.max(F.length("digits")).alias("max_width"),
        F.bool_or(F.startswith("digits", F.lit("0"))).alias("padded"),
        *cycles,
    )
    checked = checked.withColumn("width", F.when(F.col("padded") & (F.col("width") == F.col("max_width")), F.col("width")))
    checked = checked.withColumn("template", F.when(F.col("width").isNull(), F.col("plain")).otherwise(F.col("filled"))).drop("max_width", "padded", "plain", "filled")
    both = heads.join(checked, ["dataset", "field"], "left")
    period = F.coalesce(*[F.when(F.col(f"c{p}"), F.lit(p)) for p in range(1, max_cycle + 1)])
    kind = (
        F.when(F.col("constant"), "constant")
        .when(F.col("ints") & (F.col("n") >= 3) & F.col("linear"), "linear")
        .when(period.isNotNull(), "cycle")
        .when(~F.col("ints") & (F.col("n") >= 3) & (F.col("t_step") != 0) & F.col("template"), "template")
    )
    rules = both.select("*", kind.alias("type"), period.alias("period"))
    is_ = lambda *k: F.col("type").isin(*k)
    return rules.select(
        "dataset",
        "field",
        "n",
        "type",
        F.when(is_("constant"), F.get("head", F.lit(0))).alias("value"),
        F.when(is_("linear"), F.col("base")).when(is_("template"), F.col("t_base")).alias("base"),
        F.when(is_("linear"), F.col("step")).when(is_("template"), F.col("t_step")).alias("step"),
        F.when(is_("cycle"), F.slice("head", F.lit(1), F.col("period"))).alias("cycle"),
        F.when(is_("template"), F.col("prefix")).alias("prefix"),
        F.when(is_("template"), F.col("suffix")).alias("suffix"),
        F.when(is_("template"), F.col("width")).alias("width"),
    )


def values(rules: DataFrame) -> DataFrame:
    """(dataset, field, idx, text) behind every rule; generated, so nothing but the rules is read."""
    rows = rules.where("type IS NOT NULL").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.col("idx")
    text = (
        F.when(F.col("type") == "constant", F.col("value"))
        .when(F.col("type") == "linear", (F.col("base") + F.col("step") * at).cast("string"))
        .when(F.col("type") == "cycle", F.get("cycle", (at % F.greatest(F.size("cycle"), F.lit(1))).cast("int")))
        .otherwise(numbered_text(F.col("prefix"), F.col("base") + F.col("step") * at, F.col("width"), F.col("suffix")))
    )
    return rows.select("dataset", "field", "idx", text.alias("text"))


def dataset_verdict(rules: DataFrame, field_order: dict[str, int]) -> DataFrame:
    """Whether all fields of a dataset follow rules, and the first field (in the given order) that does not."""
    rank = F.create_map(*[F.lit(x) for pair in field_order.items() for x in pair])[F.col("field")]
    failed = F.col("type").isNull()
    return rules.groupBy("dataset").agg(F.bool_and(~failed).alias("rule_possible"), F.min_by("field", F.when(failed, rank)).alias("failed_field"))
