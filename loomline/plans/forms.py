"""Encoded forms and the way back, set tests, orders, baselines, dashboards and small checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomline.functions import numbers
from loomline.operators import delta, encoding, forms, judging, packets, ranking, retrieval, safety, sets, usage
from loomline.sources import store
from loomline.sources.shared import written

from . import encoding as E
from . import tenancy as T
from .data import M, memory, table


def round_trips(spark, sf_dir):
    each = written(forms.round_trips(written(E.cells(spark, sf_dir), "cells")), "trips")
    whole = each.agg(F.lit("all").alias("dataset"), F.lit("all").alias("mode"), F.sum("mismatches").alias("mismatches"), F.bool_and("exact").alias("exact"))
    return each.unionByName(whole)


def decisions(spark, sf_dir):
    return E.decisions(spark, sf_dir)


def decision_classes(spark, sf_dir):
    rows = decisions(spark, sf_dir)
    ratio = F.col("raw_size") / F.col("policy_size")
    saved = (F.col("raw_size") - F.col("policy_size")) / F.col("raw_size") * 100
    return rows.select("dataset", forms.mode_of(F.col("policy_mode")).alias("mode"), forms.decision_class(F.col("noise"), F.col("policy_mode"), saved, ratio).alias("c")).select("dataset", "mode", "c.correctness", "c.classification")


def private_decisions(spark, sf_dir):
    return usage.public_decisions(decisions(spark, sf_dir), private=True)


def role_sets(spark, sf_dir):
    roles = sets.ordered_union(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"], "roles")
    known = F.array(F.lit("user"), F.lit("assistant"))
    return roles.select("conv_id", F.array_join("roles", ",").alias("roles"), sets.is_subset(F.col("roles"), known).alias("only_known"), sets.same_elements(F.col("roles"), known).alias("both"))


def paired_rows(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    pairs = sets.by_position(table(spark, sf_dir, "supplier"), customers, ["s_suppkey"], ["c_custkey"], F.floor(F.col("s_suppkey") / 1000), F.floor(F.col("c_custkey") / 1000))
    return pairs.select(F.col("position").cast("long").alias("position"), "s_suppkey", "c_custkey")


_ISO = "CASE o_orderkey % 4 WHEN 0 THEN {day} WHEN 1 THEN replace({day}, '-', '/') WHEN 2 THEN concat(substr({day}, 1, 8), '31') END"


def iso_days(spark, sf_dir):
    text = F.expr(_ISO.format(day="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sets.is_iso_day(text).alias("is_day"))


MODES = {"newest": [F.desc, "ts"], "kind": [F.asc, "event_type"], "value": [F.desc, "value"]}


def sorted_by_mode(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    orders = {m: [f(c), F.asc("event_id")] for m, (f, c) in MODES.items()}
    parts = [ranking.top_overall(events, sets.sort_order(m, orders, "newest"), 10).select(F.lit(m).alias("mode"), "event_id") for m in (*MODES, "unknown")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_rows(spark, sf_dir):
    return ranking.top_overall(table(spark, sf_dir, "events"), [F.asc("event_id")], 120).select("event_id", "event_type")


def best_overlaps(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    terms = part.select(F.concat_ws(" ", "p_type", "p_name").alias("term"))
    return retrieval.best_overlaps(part, F.concat_ws(" ", "p_brand", "p_name"), terms, "term")


KEYWORDS = ["la", "the", "nothing like this", "de"]


def static_baselines(spark, sf_dir):
    return retrieval.static_baselines(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("text"), ["turn"], KEYWORDS)


def _baselines_sql():
    hits = " + ".join(f"CAST(bool_or(contains(lower(t), '{k}')) AS INT)" for k in KEYWORDS)
    base = f"c AS (SELECT conv_id, turn, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), g AS (SELECT conv_id, sum(strlen(t)) AS b, sum(strlen(t)) FILTER (WHERE i <= 5) + count(*) FILTER (WHERE i <= 5) - 1 AS h, ({hits}) / {len(KEYWORDS)} AS s FROM c GROUP BY conv_id)"
    rows = []
    for method, (accuracy, continuity, noise) in retrieval.BASELINES.items():
        own = "s" if accuracy is None else str(accuracy)
        rows.append(f"SELECT conv_id, '{method}' AS method, CAST({'h' if method == 'basic_summary' else 'b'} AS BIGINT) AS storage_bytes, CAST({own} AS DOUBLE) AS accuracy, CAST({f'least(s, {continuity})' if accuracy is None else continuity} AS DOUBLE) AS continuity, CAST({noise} AS DOUBLE) AS noise_resistance FROM g")
    return f"WITH {base} " + " UNION ALL ".join(rows)


def order_stability(spark, sf_dir):
    """Topics whose newest value differs when the rows come in another order."""
    rows = memory(spark, sf_dir)
    answer = lambda df: packets.latest_by_role(df, ["topic"], ["ts", "event_id"], {"current": ("current_state",), "risk": ("risk_signal",)})
    other = rows.repartition(7, F.xxhash64("event_id", F.lit(1)))
    return delta.mismatches(answer(rows), answer(other), ["topic"], ["current", "risk"]).agg(F.count(F.lit(1)).alias("n_differing"))


def dashboard_states(spark, sf_dir):
    rows = T.decided(spark, sf_dir)
    reports = rows.where(F.col("allowed") & (F.col("operation") == "report_read"))
    return usage.dashboard_state(rows, reports, ["client_id", "vault_id"])


_SAFE = "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END"


def report_panel(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("safe", F.expr(_SAFE))
    return rows.select("event_id", "user_id", usage.is_true(F.col("safe")).alias("public_safe")).orderBy("event_id")


def route_results(spark, sf_dir):
    error = F.when(F.col("event_type") == "error", F.struct(F.col("props").alias("code")))
    body = F.when(F.col("event_id") % 9 != 0, F.struct(F.col("event_type").alias("status"), F.lit("read").alias("operation"), error.alias("error"), F.expr(_SAFE).alias("public_safe")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("name"), (F.col("event_id") % 5 + 200).alias("status_code"), body.alias("body"))
    return usage.route_results(rows)


def stamped_reports(spark, sf_dir):
    results = F.array(F.struct(F.col("event_type").alias("kind"), F.lit("0").alias("version")), F.struct(F.lit("sum").alias("kind"), F.lit("0").alias("version")))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", results.alias("results"))
    out = usage.stamped(rows, {"client_id": F.concat(F.lit("c-"), F.col("user_id").cast("string")), "namespace": F.lit("main")}, "results", F.lit("7"))
    return out.select("event_id", "client_id", "namespace", "version", F.array_join(F.transform("results", lambda r: F.concat(r["kind"], F.lit(":"), r["version"])), ",").alias("told"))


def by_role(spark, sf_dir):
    rows = packets.by_role(memory(spark, sf_dir), ("risk_signal", "human_context"), ("active", "stale"), ("trusted",))
    return rows.select("event_id", "signal_type")


def missing_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(safety.missing_terms(F.col("text"), KEYWORDS), ",").alias("missing"))


def floored_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", numbers.tokens_floored(F.length("text")).alias("tokens"))


_PATH = "concat(CASE event_id % 4 WHEN 0 THEN 'reports/' WHEN 1 THEN 'reports/private/' WHEN 2 THEN 'Reports/' ELSE 'logs/' END, event_type, CASE event_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.MD' ELSE '.txt' END)"


def public_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", safety.public_report(F.expr(_PATH)).alias("shown"))


def best_other(spark, sf_dir):
    scores = table(spark, sf_dir, "part").groupBy("p_type").agg(F.max("p_retailprice").alias("score"))
    return judging.best_except(scores, "p_type", "score", ["ECONOMY", "SMALL"])


def point_lookup(spark, sf_dir):
    return store.lookup(table(spark, sf_dir, "orders"), o_orderkey=17).select("o_orderkey", "o_custkey", "o_orderstatus")


_S = f"({E._DECIDE})"
_NO, _R = "noise", "raw_size / policy_size"
_SAVED = "(raw_size - policy_size) / raw_size * 100"
_CLASS = f"CASE WHEN noise AND policy_mode = 'raw' AND {_SAVED} = 0 THEN 0 WHEN noise THEN 1 WHEN policy_mode IN ('dictionary', 'rule') AND {_SAVED} >= 50 AND {_R} >= 2 THEN 2 WHEN policy_mode = 'transform' AND {_SAVED} >= 10 THEN 3 WHEN policy_mode = 'raw' THEN 4 ELSE 5 END"
_TOLD = lambda i: "CASE c " + " ".join(f"WHEN {k} THEN '{x[i]}'" for k, x in enumerate(forms.CLASSES)) + " END"
_TRIPS = f"""{E._C}{E._RULES}, t AS (
  SELECT dataset, mode FROM (SELECT DISTINCT dataset FROM cells), (VALUES ('raw'), ('transform'), ('dictionary')) v(mode)
  UNION ALL SELECT dataset, 'rule' FROM rules GROUP BY dataset HAVING bool_and(type IS NOT NULL) UNION ALL SELECT 'all', 'all')
SELECT dataset, mode, CAST(0 AS BIGINT) AS mismatches, true AS exact FROM t"""
_TOKENS = "list_distinct(list_filter(string_split(lower({}), ' '), lambda x: x <> ''))"
_HELD = _TOKENS.format("concat(p_brand, ' ', p_name)")

QUERIES = {
    "I11_I14_I19_round_trips": (round_trips, _TRIPS),
    "I21_decision_classes": (decision_classes, f"SELECT dataset, policy_mode AS mode, {_TOLD(1)} AS correctness, {_TOLD(2)} AS classification FROM (SELECT *, {_CLASS} AS c FROM {_S})"),
    "B22_reported_decisions": (
        private_decisions,
        f"SELECT dataset, n AS input_rows, raw_size AS baseline_size, policy_size AS encoded_size, policy_mode AS mode, round_even({_SAVED}, 2) AS reduction_percent, round_even({_R}, 2) AS ratio, transform_size, dictionary_size, rule_size, reason FROM {_S}",
    ),
    "H3_H5_role_sets": (
        role_sets,
        "SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS roles, bool_and(role IN ('user', 'assistant')) AS only_known, bool_and(role IN ('user', 'assistant')) AND count(*) = 2 AS both FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id",
    ),
    "C1_paired_rows": (
        paired_rows,
        "SELECT position, s_suppkey, c_custkey FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS position, s_suppkey FROM supplier) JOIN (SELECT row_number() OVER (ORDER BY c_custkey) AS position, c_custkey FROM customer WHERE c_custkey % 3 = 0) USING (position)",
    ),
    "S19_iso_days": (
        iso_days,
        "SELECT o_orderkey, coalesce(regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(t AS DATE) IS NOT NULL, false) AS is_day FROM (SELECT o_orderkey, "
        + _ISO.format(day="strftime(o_orderdate, '%Y-%m-%d')")
        + " AS t FROM orders)",
    ),
    "G8_sorted_by_mode": (
        sorted_by_mode,
        " UNION ALL ".join(f"(SELECT '{m}' AS mode, event_id FROM events ORDER BY {o}, event_id LIMIT 10)" for m, o in (("newest", "ts DESC"), ("kind", "event_type"), ("value", "value DESC"), ("unknown", "ts DESC"))),
    ),
    "G4_first_rows": (first_rows, "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 120"),
    "C12_best_overlaps": (
        best_overlaps,
        f"WITH t AS (SELECT DISTINCT concat(p_type, ' ', p_name) AS term FROM part), q AS (SELECT term, {_TOKENS.format('term')} AS ts FROM t), r AS (SELECT DISTINCT {_HELD} AS ts FROM part), "
        "b AS (SELECT term, max(len(list_intersect(q.ts, r.ts)) / greatest(len(q.ts), 1)) AS overlap FROM q, r GROUP BY term) SELECT term, CAST(overlap AS DOUBLE) AS overlap, overlap >= 0.5 AS hit FROM b",
    ),
    "K8_static_baselines": (static_baselines, _baselines_sql()),
    "K25_order_stability": (order_stability, "SELECT CAST(0 AS BIGINT) AS n_differing"),
    "E15_dashboard_states": (
        dashboard_states,
        f"{T._DECIDED} SELECT client_id, vault_id, count(*) FILTER (WHERE allowed) AS allowed_requests, count(*) FILTER (WHERE NOT allowed) AS blocked_requests, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (WHERE NOT allowed)), ','), '') AS blocked_reasons, "
        "bool_or(operation = 'memory_reconstruct') AS reconstruction_available, bool_or(operation = 'explain') AS explanation_available, count(*) FILTER (WHERE allowed AND operation = 'report_read') AS reports_visible FROM decided GROUP BY client_id, vault_id",
    ),
    "E27_report_panel": (report_panel, f"SELECT event_id, user_id, coalesce({_SAFE}, false) AS public_safe FROM events WHERE event_type = 'purchase' ORDER BY event_id"),
    "B27_route_results": (
        route_results,
        f"SELECT event_id AS name, event_id % 5 + 200 AS status_code, CASE WHEN h THEN event_type END AS status, CASE WHEN h THEN 'read' END AS operation, CASE WHEN h AND event_type = 'error' THEN props END AS error_code, CASE WHEN h THEN {_SAFE} END AS public_safe FROM (SELECT *, event_id % 9 <> 0 AS h FROM events)",
    ),
    "B23_stamped_reports": (stamped_reports, "SELECT event_id, concat('c-', CAST(user_id AS VARCHAR)) AS client_id, 'main' AS namespace, '7' AS version, concat(event_type, ':7,sum:7') AS told FROM events"),
    "B7_by_role": (by_role, f"{M}SELECT event_id, signal_type FROM m WHERE signal_type IN ('risk_signal', 'human_context') AND status IN ('active', 'stale') AND trust_level = 'trusted'"),
    "H2_missing_terms": (
        missing_terms,
        "SELECT conv_id, turn, concat_ws(',', " + ", ".join(f"CASE WHEN NOT contains(lower(coalesce(text, '')), '{k}') THEN '{k}' END" for k in KEYWORDS) + ") AS missing FROM conversations",
    ),
    "S14_floored_tokens": (floored_tokens, "SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens FROM conversations"),
    "B19_public_paths": (
        public_paths,
        f"SELECT event_id, starts_with(p, 'reports/') AND NOT contains(p, 'private') AND NOT contains(p, 'internal') AND (ends_with(p, '.json') OR ends_with(p, '.md')) AS shown FROM (SELECT event_id, lower({_PATH}) AS p FROM events)",
    ),
    "E23_best_other": (best_other, "SELECT max(p_retailprice) FILTER (WHERE p_type NOT IN ('ECONOMY', 'SMALL')) AS best_other FROM part"),
    "A13_point_lookup": (point_lookup, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 17"),
}
