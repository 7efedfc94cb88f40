"""Queries of row shaping, scores and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import packets, scoring, shaping

from .data import M, memory, table
from .packets import AT, ORDER, TRUST

#: Event fields that the memory view has, with their lengths.
FIELDS = {"event_id": 6, "event_type": 4, "state_before": 1000, "state_after": 1000, "status": 80}


def sanitized(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("role") != "system", F.col("role")).alias("topic"))
    return shaping.sanitized(turns, F.col("turn") + 1).select("conv_id", "turn", "text", "topic", "signal_type", "status", "trust_level", "timestamp_index")


def _events(spark, sf_dir):
    return memory(spark, sf_dir).withColumn("state_before", F.when(F.col("k") != 41, F.col("state_before")))


_BAD = "CASE WHEN k <> 41 THEN state_before END"
_VERDICT = f"{M}, v AS (SELECT topic, count(*) AS n, count(*) FILTER (WHERE {_BAD} IS NULL) AS n_bad FROM m GROUP BY topic), w AS (SELECT *, CASE WHEN n > 500 THEN 'payload_too_large' WHEN n_bad > 0 THEN 'missing_fields' ELSE 'accepted' END AS verdict FROM v)"


def verdicts(spark, sf_dir):
    return shaping.batch_verdicts(_events(spark, sf_dir), ["topic"], FIELDS)


def strict(spark, sf_dir):
    return shaping.strict_events(_events(spark, sf_dir), ["topic"], FIELDS)


def lenient(spark, sf_dir):
    rows = memory(spark, sf_dir).select(F.when(F.col("status") != "stale", F.col("event_id")).alias("event_id"), F.col("topic").alias("user_id"), F.when(F.col("k") < 90, F.col("event_type")).alias("type"), F.col("memory_value").alias("content"), F.col("event_id").alias("n"))
    return shaping.lenient_events(rows, F.concat(F.lit("evt_"), F.col("n").cast("string")))


def summary(spark, sf_dir):
    rows = memory(spark, sf_dir).withColumn("event_type", shaping.aliased(F.col("event_type"), {"click": "tap", "view": "look"}))
    out = shaping.renamed(rows, {"event_id": "id", "event_type": "kind", "state_before": "from_state", "state_after": "to_state", "signal_type": "signal"})
    allowed = shaping.allowed_only(F.array("from_state", "to_state"), ["open", "held"])
    return out.withColumn("shown", F.array_join(allowed, ","))


def console(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return shaping.console(rows, "00012", ("c_name", "c_mktsegment"), c_mktsegment="all").select("c_custkey", "c_name")


def approvals(spark, sf_dir):
    log = table(spark, sf_dir, "orders")
    out = shaping.approvals(log, "o_custkey", "o_orderkey", "o_orderstatus", "F")
    return out.select("o_custkey", "o_orderkey", "outcome", shaping.vault_id(F.concat(F.lit("Client / "), F.col("o_orderpriority"))).alias("vault_id"))


def trust_scores(spark, sf_dir):
    rows = memory(spark, sf_dir)
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    parts = rows.groupBy("client_id").agg(
        share(F.col("signal_type") != "origin").alias("reconstruction"), (F.count_distinct("memory_value") / F.count(F.lit(1))).alias("compression"), share(F.col("status") == "active").alias("continuity"),
        share(F.col("status") != "stale").alias("noise"), share(F.col("trust_level") == "trusted").alias("isolation"), share(F.col("importance") != "none").alias("latency"),
    )
    return scoring.weighted(parts, scoring.TRUST_WEIGHTS).select("client_id", "score", "band")


_SHARE = "count(*) FILTER (WHERE {c}) / count(*)"
_PARTS = [_SHARE.format(c="signal_type <> 'origin'"), "count(DISTINCT memory_value) / count(*)", _SHARE.format(c="status = 'active'"), _SHARE.format(c="status <> 'stale'"), _SHARE.format(c="trust_level = 'trusted'"), _SHARE.format(c="importance <> 'none'")]
_SCORE = " + ".join(f"({p}) * {w}" for p, w in zip(_PARTS, scoring.TRUST_WEIGHTS.values(), strict=True))
_BAND = "CASE " + " ".join(f"WHEN score >= {least} THEN '{name}'" for least, name in scoring.BANDS) + " ELSE 'failing' END"
FACTS = {"current_state": ("current_state",), "latent_risk": ("risk_signal",)}


def preserved(spark, sf_dir):
    rows = memory(spark, sf_dir)
    own = packets.latest_by_role(packets.trusted_rows(rows), ["topic"], ORDER, FACTS)
    stale = rows.groupBy("topic").agg(packets.newest(F.col("memory_value"), ORDER, F.col("status") == "stale").alias("stale"))
    both = own.join(stale, "topic", "left")
    made = both.select("topic", F.array_compact(F.array(*FACTS)).alias("required"), F.array_compact(F.array("stale")).alias("old"), F.concat_ws("; ", *FACTS).alias("packet"))
    return scoring.preservation(made, rows.select("topic", "memory_value"), "topic", "required", "old", "packet", "memory_value")


def leaks(spark, sf_dir):
    rows = memory(spark, sf_dir)
    truth = packets.latest_by_role(packets.trusted_rows(rows), ["topic"], ORDER, {"current_state": ("current_state",)})
    return scoring.answer_leaks(rows.select("topic", "event_id", "memory_value"), truth, ["topic"], "memory_value", ["current_state"])


def recounted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    reports = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(3).cast("long").alias("passed"), F.lit(10).cast("long").alias("total"))
    return scoring.recount(reports, "o_custkey", orders.withColumn("ok", F.col("o_orderstatus") == "F"), "ok", "passed", "total")


_FACT = ", ".join(f"arg_max(memory_value, {AT}) FILTER (WHERE signal_type = '{r[0]}') AS {f}" for f, r in FACTS.items())
QUERIES = {
    "B1_sanitized_rows": (
        sanitized,
        "SELECT conv_id, turn, substr(text, 1, 1000) AS text, CASE WHEN role <> 'system' THEN role ELSE 'unknown' END AS topic, 'note' AS signal_type, 'active' AS status, 'trusted' AS trust_level, turn + 1 AS timestamp_index FROM conversations",
    ),
    "B2_batch_verdicts": (verdicts, f"{_VERDICT} SELECT topic, n, n_bad, verdict FROM w"),
    "B2_strict_events": (
        strict,
        f"{_VERDICT} SELECT topic, substr(CAST(event_id AS VARCHAR), 1, 6) AS event_id, substr(event_type, 1, 4) AS event_type, state_before, state_after, status FROM m WHERE topic IN (SELECT topic FROM w WHERE verdict = 'accepted')",
    ),
    "B3_lenient_events": (
        lenient,
        f"{M}SELECT CASE WHEN status <> 'stale' THEN CAST(event_id AS VARCHAR) ELSE concat('evt_', event_id) END AS event_id, CAST(topic AS VARCHAR) AS user_id, CASE WHEN k < 90 THEN event_type ELSE 'event' END AS type, memory_value AS content FROM m",
    ),
    "B14_B16_event_summary": (
        summary,
        f"{M}SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END AS kind, state_before AS from_state, state_after AS to_state, signal_type AS signal, "
        "concat_ws(',', CASE WHEN state_before IN ('open', 'held') THEN state_before END, CASE WHEN state_after IN ('open', 'held') THEN state_after END) AS shown FROM m",
    ),
    "B18_console_filter": (console, "SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), '00012')"),
    "K29_approvals": (
        approvals,
        "SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'approved' ELSE 'already_approved' END AS outcome, "
        "concat('vault_', left(regexp_replace(lower(concat('Client / ', o_orderpriority)), '[ /]', '_', 'g'), 24)) AS vault_id FROM orders WHERE o_orderstatus = 'F'",
    ),
    "K19_trust_scores": (trust_scores, f"{M}, s AS (SELECT client_id, round_even({_SCORE}, 2) AS score FROM m GROUP BY client_id) SELECT client_id, score, {_BAND} AS band FROM s"),
    "K14_preservation": (
        preserved,
        f"{M}, p AS (SELECT topic, {_FACT} FROM m WHERE {TRUST} GROUP BY topic), o AS (SELECT topic, arg_max(memory_value, {AT}) FILTER (WHERE status = 'stale') AS stale, sum(length(memory_value)) AS chars FROM m GROUP BY topic), "
        "q AS (SELECT topic, concat_ws('; ', current_state, latent_risk) AS packet, stale, greatest(1, CAST(floor(chars / 4) AS BIGINT)) AS raw_tokens FROM p JOIN o USING (topic)), "
        "r AS (SELECT *, greatest(1, CAST(floor(length(packet) / 4) AS BIGINT)) AS packet_tokens FROM q) "
        "SELECT topic, CAST(0 AS BIGINT) AS n_missing, CAST(CASE WHEN contains(lower(packet), lower(stale)) THEN 1 ELSE 0 END AS BIGINT) AS n_stale, raw_tokens, packet_tokens, round_even((1 - packet_tokens / raw_tokens) * 100, 2) AS reduction FROM r",
    ),
    "K24_answer_leaks": (
        leaks,
        f"{M}, t AS (SELECT topic, arg_max(memory_value, {AT}) FILTER (WHERE signal_type = 'current_state') AS c FROM m WHERE {TRUST} GROUP BY topic) SELECT topic, event_id, memory_value FROM m JOIN t USING (topic) WHERE contains(memory_value, c)",
    ),
    "E22_recount": (
        recounted,
        "WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS p, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey AS o_custkey, CAST(3 AS BIGINT) AS passed, CAST(10 AS BIGINT) AS total, coalesce(p, 0) AS counted_passed, coalesce(n, 0) AS counted_all "
        "FROM customer LEFT JOIN c ON c.o_custkey = c_custkey WHERE coalesce(p, 0) <> 3 OR coalesce(n, 0) <> 10",
    ),
}
