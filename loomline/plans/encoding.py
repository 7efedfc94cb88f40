"""Delta, rule, dictionary and policy queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomline.operators import delta, encoding, rules
from loomline.operators.neighbours import numbered
from loomline.sources.shared import written

from .data import table

#: Datasets: table, its row number from 0, its fields in order.
DATASETS = {
    "nation": ("n_nationkey", ("n_nationkey", "n_name", "n_regionkey")),
    "region": ("r_regionkey", ("r_regionkey", "r_name")),
    "customer": ("c_custkey", ("c_custkey", "c_name")),
    "supplier": ("s_suppkey", ("s_suppkey", "s_name", "s_nationkey")),
    "part": ("p_partkey", ("p_partkey", "p_name", "p_brand", "p_type", "p_size")),
    "orders": ("o_orderkey", ("o_custkey", "o_orderstatus", "o_orderpriority")),
}
FIELD_ORDER = {f: i for _, fields in DATASETS.values() for i, f in enumerate(fields)} | {"role": 0, "text": 1, "importance": 2, "l_linenumber": 0}
INTS = {"n_nationkey", "n_regionkey", "r_regionkey", "c_custkey", "s_suppkey", "s_nationkey", "p_partkey", "p_size", "o_custkey", "l_linenumber"}


def rows(spark, sf_dir):
    """The driver tables in wide form with sizes; turns of conversations are one dataset more, of low importance by rule."""
    sized = lambda df, dataset, idx, fields: encoding.with_pairs(rules.wide_form(df, F.lit(dataset), idx, fields), fields)
    parts = [sized(table(spark, sf_dir, t), t, F.col(idx), list(fields)) for t, (idx, fields) in DATASETS.items()]
    turns = numbered(table(spark, sf_dir, "conversations"), [], ["conv_id", "turn"], F.floor(F.col("conv_id") / 1000))
    turns = turns.withColumn("importance", F.when(F.col("turn") < 0, "high").otherwise("low"))
    parts.append(sized(turns, "conversations", F.col("position") - 1, ["role", "text", "importance"]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def cells(spark, sf_dir):
    """rows() in long form."""
    return rules.cells_of(rows(spark, sf_dir))


def written_cells(spark, sf_dir):
    """cells() as a table, for what reads them more than once."""
    return written(cells(spark, sf_dir), "cells")


def _cells_sql() -> str:
    rows = [f"SELECT '{t}' AS dataset, CAST({idx} AS BIGINT) AS idx, '{f}' AS field, CAST({f} AS VARCHAR) AS text, {f in INTS} AS is_int FROM {t}" for t, (idx, fields) in DATASETS.items() for f in fields]
    turns = "(SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, role, text, CASE WHEN turn < 0 THEN 'high' ELSE 'low' END AS importance FROM conversations)"
    rows += [f"SELECT 'conversations', idx, '{f}', {f}, false FROM {turns}" for f in ("role", "text", "importance")]
    return " UNION ALL ".join(rows)


#: Text before, within and after the first integer; RE2 spelling.
_T = "'^(.*?)(-?[0-9]+)(.*)$'"
_NUMBERED = (
    "t_prefix || CASE WHEN {v} < 0 THEN '-' ELSE '' END || CASE WHEN width IS NOT NULL AND length(CAST(abs({v}) AS VARCHAR)) < width "
    "THEN lpad(CAST(abs({v}) AS VARCHAR), CAST(width AS INTEGER), '0') ELSE CAST(abs({v}) AS VARCHAR) END || t_suffix"
)
_RULES = f"""
heads AS (
  SELECT dataset, field, count(*) AS n, list(text ORDER BY idx) FILTER (WHERE idx < 20) AS head, bool_and(is_int) AS ints,
    CASE WHEN bool_or(starts_with(d, '0')) AND min(length(d)) = max(length(d)) THEN min(length(d)) END AS width
  FROM (SELECT *, replace(coalesce(regexp_extract(text, {_T}, 2), ''), '-', '') AS d FROM cells) GROUP BY dataset, field),
h AS (
  SELECT *, TRY_CAST(head[1] AS BIGINT) AS base, TRY_CAST(head[2] AS BIGINT) - TRY_CAST(head[1] AS BIGINT) AS step,
    regexp_extract(head[1], {_T}, 1) AS t_prefix, regexp_extract(head[1], {_T}, 3) AS t_suffix, TRY_CAST(regexp_extract(head[1], {_T}, 2) AS BIGINT) AS t_base,
    TRY_CAST(regexp_extract(head[2], {_T}, 2) AS BIGINT) - TRY_CAST(regexp_extract(head[1], {_T}, 2) AS BIGINT) AS t_step
  FROM heads),
checked AS (
  SELECT dataset, field, any_value(h.n) AS n, bool_and(TRY_CAST(text AS BIGINT) IS NOT DISTINCT FROM base + step * idx) AS linear,
    bool_and(text IS NOT DISTINCT FROM {_NUMBERED.format(v='(t_base + t_step * idx)')}) AS template,
    coalesce({', '.join(f'CASE WHEN any_value(n) >= {max(4, 2 * p)} AND bool_and(text IS NOT DISTINCT FROM head[idx % {p} + 1]) THEN {p} END' for p in range(1, 21))}) AS period,
    bool_and(text IS NOT DISTINCT FROM head[1]) AS constant
  FROM cells JOIN h USING (dataset, field) GROUP BY dataset, field),
rules AS (
  SELECT dataset, field, n, type, CASE WHEN type = 'constant' THEN head[1] END AS value, CASE type WHEN 'linear' THEN base WHEN 'template' THEN t_base END AS base,
    CASE type WHEN 'linear' THEN step WHEN 'template' THEN t_step END AS step, CASE WHEN type = 'cycle' THEN head[1:period] END AS cycle,
    CASE WHEN type = 'template' THEN t_prefix END AS prefix, CASE WHEN type = 'template' THEN t_suffix END AS suffix, CASE WHEN type = 'template' THEN width END AS width
  FROM (SELECT h.*, period, CASE WHEN constant THEN 'constant' WHEN ints AND h.n >= 3 AND linear THEN 'linear' WHEN period IS NOT NULL THEN 'cycle'
          WHEN NOT ints AND h.n >= 3 AND t_step <> 0 AND template THEN 'template' END AS type FROM h JOIN checked USING (dataset, field)))"""

_LINES = "SELECT CAST(l_orderkey AS VARCHAR) AS dataset, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, 'l_linenumber' AS field, CAST(l_linenumber AS VARCHAR) AS text, true AS is_int FROM lineitem"


def line_cells(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # an order's lines are few
    rows = table(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(own) - 1)
    return rules.long_form(rows, F.col("l_orderkey").cast("string"), F.col("idx"), ["l_linenumber"])


def _told(found):
    return found.select("dataset", "field", "n", "type", "value", "base", "step", F.array_join("cycle", ",").alias("cycle"), "prefix", "suffix", F.col("width").cast("long").alias("width"))


_TOLD = "SELECT dataset, field, n, type, value, base, step, array_to_string(cycle, ',') AS cycle, prefix, suffix, CAST(width AS BIGINT) AS width FROM rules"


def column_rules(spark, sf_dir):
    return _told(rules.discover(written_cells(spark, sf_dir)))


def line_rules(spark, sf_dir):
    return _told(rules.discover(line_cells(spark, sf_dir)))


def rule_values(spark, sf_dir):
    return rules.values(rules.discover(written_cells(spark, sf_dir)))


def rule_verdicts(spark, sf_dir):
    return rules.dataset_verdict(rules.discover(written_cells(spark, sf_dir)), FIELD_ORDER)


def dictionary_codes(spark, sf_dir):
    return encoding.dictionary_columns(cells(spark, sf_dir)).select("dataset", "field", "text", F.col("code").cast("long").alias("code"), "uses")


def decisions(spark, sf_dir):
    return encoding.decide_rows(rows(spark, sf_dir), FIELD_ORDER)


KEYS, ORDER, COLUMNS = ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]


def _year():
    return F.year("o_orderdate")


def delta_encoded(spark, sf_dir):
    out = delta.encode(table(spark, sf_dir, "orders"), KEYS, ORDER, COLUMNS, _year())
    return out.select("o_custkey", "o_orderkey", "is_origin", F.col("d_o_orderstatus.v").alias("new_status"), F.col("d_o_orderpriority.v").alias("new_priority"))


def delta_decoded(spark, sf_dir):
    encoded = delta.encode(table(spark, sf_dir, "orders"), KEYS, ORDER, COLUMNS, _year())
    return delta.decode(encoded, KEYS, ORDER, COLUMNS, _year()).select("o_custkey", "o_orderkey", *COLUMNS)


def delta_mismatches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    back = delta.decode(delta.encode(orders, KEYS, ORDER, COLUMNS, _year()), KEYS, ORDER, COLUMNS, _year())
    return delta.mismatches(orders, back, ["o_custkey", "o_orderkey"], COLUMNS).agg(F.count(F.lit(1)).alias("n_mismatches"))


_C = f"WITH cells AS ({_cells_sql()}),"
_J = "(length(t) + 2 + len(regexp_extract_all(t, '[\"\\\\\\n\\r\\t\\x08\\x0C]')) + 5 * len(regexp_extract_all(t, '[\\x00-\\x07\\x0B\\x0E-\\x1F\\x7F-\\x{FFFF}]')) + 11 * len(regexp_extract_all(t, '[\\x{10000}-\\x{10FFFF}]')))"


def _size(column: str, is_int: str = "is_int") -> str:
    return f"CASE WHEN {column} IS NULL THEN 4 WHEN {is_int} THEN length({column}) ELSE {_J.replace('(t', '(' + column)} END".replace("length(t)", f"length({column})")


_LOWS = "('none', 'low', 'noise')"
_NOISY = " OR ".join(f"contains(lower(text), '{w}')" for w in encoding.NOISE_WORDS)
_ORDER_OF = "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for f, i in FIELD_ORDER.items()) + " END"
_DECIDE = f"""{_C}{_RULES},
z AS (SELECT *, {_size('text')} AS size, length(field) + 3 AS ks, lag(text) OVER (PARTITION BY dataset, field ORDER BY idx) IS DISTINCT FROM text OR idx = 0 AS changed FROM cells),
r AS (SELECT dataset, idx, sum(ks + size) + count(*) + 1 AS row_size, coalesce(sum(ks + size) FILTER (WHERE changed), 0) + greatest(count(*) FILTER (WHERE changed) - 1, 0) + 2 AS delta FROM z GROUP BY ALL),
rt AS (SELECT dataset, count(*) AS n, sum(row_size) + count(*) + 1 AS raw_size, sum(CASE WHEN idx = 0 THEN row_size ELSE delta END) + greatest(count(*) - 2, 0) + {len('{"m":"transform","o":,"d":[]}')} AS transform_size FROM r GROUP BY dataset),
dv AS (SELECT dataset, field, text, any_value(size) AS size, any_value(ks) AS ks, count(*) AS uses, row_number() OVER (PARTITION BY dataset, field ORDER BY min(idx)) - 1 AS code FROM z GROUP BY dataset, field, text),
dc AS (SELECT dataset, sum(uses) AS n, any_value(ks) AS ks, CASE WHEN count(*) < sum(uses)
    THEN sum(size) + count(*) - 1 + sum(length(CAST(code AS VARCHAR)) * uses) + sum(uses) - 1 + {len('{"t":"dict","v":[],"i":[]}')} ELSE sum(size * uses) + sum(uses) - 1 + {len('{"t":"raw","v":[]}')} END AS s FROM dv GROUP BY dataset, field),
ds AS (SELECT dataset, sum(s + 2 * ks - 1) + 2 * (count(*) - 1) + length(CAST(CAST(max(n) AS BIGINT) AS VARCHAR)) + {len('{"m":"dictionary","n":,"o":[],"c":{}}')} AS dictionary_size FROM dc GROUP BY dataset),
ru AS (SELECT dataset, bool_and(type IS NOT NULL) AS rule_possible, arg_min(field, {_ORDER_OF}) FILTER (WHERE type IS NULL) AS failed_field, max(n) AS n, count(*) AS k,
    sum(length(field) + 3 + CASE type
      WHEN 'constant' THEN {_size('value', 'ints')} + {len('{"rule_found":true,"type":"constant","value":}')}
      WHEN 'linear' THEN length(CAST(base AS VARCHAR)) + length(CAST(step AS VARCHAR)) + {len('{"rule_found":true,"type":"linear","base":,"step":}')}
      WHEN 'cycle' THEN CASE WHEN ints THEN list_sum(list_transform(cycle, lambda t: length(t))) ELSE list_sum(list_transform(cycle, lambda t: {_J})) END
        + len(cycle) - 1 + length(CAST(len(cycle) AS VARCHAR)) + {len('{"rule_found":true,"type":"cycle","cycle":[],"cycle_length":}')}
      WHEN 'template' THEN {_size('prefix', 'false')} + {_size('suffix', 'false')} + length(CAST(base AS VARCHAR)) + length(CAST(step AS VARCHAR)) + coalesce(length(CAST(width AS VARCHAR)), 4)
        + {len('{"rule_found":true,"type":"string_numeric_template","prefix":,"suffix":,"base":,"step":,"width":,"reason":"Symbolic numeric template rule discovered"}')} END) AS s
  FROM rules JOIN (SELECT dataset, field, bool_and(is_int) AS ints FROM cells GROUP BY ALL) USING (dataset, field) GROUP BY dataset),
rs AS (SELECT dataset, rule_possible, failed_field, CASE WHEN rule_possible THEN s + k - 1 + length(CAST(n AS VARCHAR)) + {len('{"m":"rule","n":,"r":{}}')} END AS rule_size FROM ru),
no AS (SELECT dataset, max(idx) + 1 AS n, count(text) FILTER (WHERE NOT is_int) AS texts, count(DISTINCT text) FILTER (WHERE NOT is_int) AS different,
    count(*) FILTER (WHERE field = 'importance' AND lower(text) IN {_LOWS}) AS low, count(*) FILTER (WHERE NOT is_int AND ({_NOISY})) AS noisy FROM cells GROUP BY dataset),
nv AS (SELECT dataset, n >= 25 AND texts > 0 AND (low / n >= 0.8 AND noisy / greatest(texts, 1) >= 0.5 OR low / n >= 0.9 AND different / greatest(texts, 1) >= 0.7) AS noise FROM no),
b AS (SELECT *, list_min(list_filter([{{'s': raw_size, 'r': 0, 'm': 'raw'}}, {{'s': transform_size, 'r': 1, 'm': 'transform'}}, {{'s': dictionary_size, 'r': 2, 'm': 'dictionary'}}, {{'s': rule_size, 'r': 3, 'm': 'rule'}}], lambda o: o.s IS NOT NULL)) AS best
  FROM rt JOIN ds USING (dataset) JOIN rs USING (dataset) JOIN nv USING (dataset)),
p AS (SELECT *, (raw_size - best.s) / raw_size * 100 AS pct FROM b),
o AS (SELECT *, CASE WHEN noise THEN 'noise' WHEN best.m = 'raw' THEN 'raw is smallest' WHEN pct < 10 THEN 'saves too little' ELSE 'saves enough' END AS reason FROM p)
SELECT dataset, n, CAST(raw_size AS BIGINT) AS raw_size, CAST(transform_size AS BIGINT) AS transform_size, CAST(dictionary_size AS BIGINT) AS dictionary_size, rule_possible, failed_field,
  CAST(rule_size AS BIGINT) AS rule_size, best.m AS best_mode, CAST(best.s AS BIGINT) AS best_size, round_even(pct, 2) AS saved_percent, noise,
  CASE WHEN reason = 'saves enough' THEN best.m ELSE 'raw' END AS policy_mode, CAST(CASE WHEN reason = 'saves enough' THEN best.s ELSE raw_size END AS BIGINT) AS policy_size, reason FROM o"""

_LAG = "lag({c}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_NEW = "CASE WHEN {l} IS DISTINCT FROM {c} THEN {c} END"
QUERIES = {
    "F1_delta_encode": (
        delta_encoded,
        "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_origin, "
        + ", ".join(_NEW.format(l=_LAG.format(c=c), c=c) + f" AS {n}" for c, n in (("o_orderstatus", "new_status"), ("o_orderpriority", "new_priority")))
        + " FROM orders",
    ),
    "F2_delta_decode": (delta_decoded, "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders"),
    "I18_round_trip": (delta_mismatches, "SELECT CAST(0 AS BIGINT) AS n_mismatches"),
    "I6_column_rules": (column_rules, f"{_C}{_RULES} {_TOLD}"),
    "I4_line_rules": (line_rules, f"WITH cells AS ({_LINES}),{_RULES} {_TOLD}"),
    "I10_rule_values": (rule_values, f"{_C}{_RULES} SELECT dataset, field, idx, text FROM cells JOIN rules USING (dataset, field) WHERE type IS NOT NULL"),
    "I9_rule_verdict": (
        rule_verdicts,
        f"{_C}{_RULES} SELECT dataset, bool_and(type IS NOT NULL) AS rule_possible, arg_min(field, {_ORDER_OF}) FILTER (WHERE type IS NULL) AS failed_field FROM rules GROUP BY dataset",
    ),
    "I13_dictionary_codes": (
        dictionary_codes,
        f"{_C[:-1]} SELECT dataset, field, text, row_number() OVER (PARTITION BY dataset, field ORDER BY min(idx)) - 1 AS code, count(*) AS uses FROM cells GROUP BY dataset, field, text",
    ),
    "I17_policy": (decisions, _DECIDE),
}
