"""Packet and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import packets as P
from loomline.operators import ranking as R

from .data import M, memory, table

ORDER = ["ts", "event_id"]


def _week():
    return F.date_trunc("week", F.col("ts"))


def continuity_packet_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest value of each event type, event count and types of every user: one shuffle."""
    events = table(spark, sf_dir, "events")
    kinds = ("click", "view", "purchase", "signup", "error")
    return events.groupBy("user_id").agg(
        *[P.newest(F.col("value"), ORDER, F.col("event_type") == k).alias(f"latest_{k}") for k in kinds],
        F.count(F.lit(1)).alias("n_events"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("event_types"),
    )


_PACKET_SQL = (
    "SELECT user_id, "
    + ", ".join(f"arg_max(value, {{'t': ts, 'o': event_id}}) FILTER (WHERE event_type = '{k}') AS latest_{k}" for k in ("click", "view", "purchase", "signup", "error"))
    + ", count(*) AS n_events, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types FROM events GROUP BY user_id"
)

ROLES = {"current_state": ("current_state",), "old_state": ("origin",), "human": ("human_context",), "latent_risk": ("risk_signal",), "evidence": ("counter_evidence",)}
PRODUCT = {"current_state": ("current_state", "current_commitment"), "decision_reason": ("human_context", "lineage"), "latent_risk": ("risk_signal", "latent_risk"), "next_action": ("review_action", "next"), "old_state": ("origin", "old_state")}
AT = "{'t': ts, 'o': event_id}"


def _roles_sql(outputs: dict, where: str, keys: str = "topic") -> str:
    cols = ", ".join(f"arg_max(memory_value, {AT}) FILTER (WHERE signal_type IN ({', '.join(repr(r) for r in roles)})) AS {name}" for name, roles in outputs.items())
    return f"{M}SELECT {keys}, {cols} FROM m WHERE {where} GROUP BY {keys}"


TRUST = "trust_level = 'trusted' AND status IN ('active', 'historical')"


def latest_by_role(spark, sf_dir):
    return P.latest_by_role(memory(spark, sf_dir).where("trust_level = 'trusted'"), ["topic"], ORDER, ROLES)


def product_packet(spark, sf_dir):
    return P.latest_by_role(P.trusted_rows(memory(spark, sf_dir)), ["client_id", "topic"], ORDER, PRODUCT)


def scoped_packet(spark, sf_dir):
    rows = P.in_scope(memory(spark, sf_dir), "client-2", namespace="main")
    return P.latest_by_role(P.trusted_rows(rows), ["client_id", "vault_id", "namespace", "topic"], ORDER, PRODUCT)


def account_packet(spark, sf_dir):
    return P.account_packet(memory(spark, sf_dir), ["topic"], ORDER, ("origin", "current_state", "review_action"), ("risk_signal", "human_context", "counter_evidence"))


def account_signal_lists(spark, sf_dir):
    rows = P.trusted_rows(memory(spark, sf_dir)).where(F.col("signal_type").isin("risk_signal", "human_context", "counter_evidence"))
    return P.signal_list(rows, ["topic"], ORDER, _week()).select("topic", "signal_type", "event_id", "memory_value", F.col("position").cast("long").alias("position"))


def entity_packet(spark, sf_dir):
    return P.entity_packet(memory(spark, sf_dir), ["topic"], ORDER, ("click", "signup"))


_ENTITY_SQL = f"""{M}SELECT topic,
  CASE WHEN bool_or(status = 'active' AND event_type IN ('click', 'signup')) THEN arg_max(state_after, {AT}) FILTER (WHERE status = 'active' AND event_type IN ('click', 'signup'))
    ELSE arg_max(state_after, {AT}) FILTER (WHERE status = 'active') END AS current_state,
  CASE WHEN bool_or(status = 'active' AND event_type IN ('click', 'signup')) THEN arg_max(state_before, {AT}) FILTER (WHERE status = 'active' AND event_type IN ('click', 'signup'))
    ELSE arg_min(state_before, {AT}) END AS previous_state,
  count(*) FILTER (WHERE status = 'active' AND state_before IS DISTINCT FROM state_after) AS n_changes,
  coalesce(array_to_string(list_sort(list(DISTINCT signal_type) FILTER (WHERE status = 'active')), ','), '') AS active_signals,
  coalesce(array_to_string(list_sort(list(DISTINCT signal_type) FILTER (WHERE status = 'stale')), ','), '') AS stale_signals,
  count(*) AS n_events
FROM m GROUP BY topic"""


def meaningful_changes(spark, sf_dir):
    return P.meaningful_changes(memory(spark, sf_dir), ["topic"], ORDER).select("topic", "event_id", "change")


def simple_packet(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return P.simple_packet(rows, ["conv_id"], ["turn"], "text", "role")


def preferred_row(spark, sf_dir):
    wanted = (F.col("status") == "active") & (F.col("importance") == "high")
    return P.preferred_row(memory(spark, sf_dir), ["topic"], ORDER, wanted, ["event_id", "signal_type", "status", "memory_value"])


def action_and_explanation(spark, sf_dir):
    rows = memory(spark, sf_dir)
    packets = P.entity_packet(rows, ["topic"], ORDER, ("click", "signup"))
    counters = P.trusted_rows(rows).where("signal_type = 'counter_evidence' AND memory_value <> 'Receipt on file'").groupBy("topic").agg(F.count(F.lit(1)).alias("n_counter_evidence"))
    both = packets.join(counters, "topic", "left").fillna(0, ["n_counter_evidence"])
    out = P.explanation(P.least_harm_action(both), "internal")
    return out.select("topic", "n_counter_evidence", "recommended_action", "human_review_required", "explanation", "sensitive_details_allowed")


def last_events_per_user(spark, sf_dir):
    return R.last_per_group(memory(spark, sf_dir), ["topic"], ORDER, 3).select("topic", "event_id", "memory_value", "rank")


def first_and_last_events(spark, sf_dir):
    return R.first_and_last(memory(spark, sf_dir), ["topic"], ORDER, 20).select("topic", "event_id", "rank", "part")


def top_orders_per_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return R.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderdate"), F.asc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


def top_orders(spark, sf_dir):
    return R.top_overall(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.desc("o_orderdate"), F.asc("o_orderkey")], 40).select("o_orderkey", "o_totalprice")


#: How loud a signal is.
LOUDNESS = {"risk_signal": 90, "current_state": 60, "human_context": 50, "counter_evidence": 40, "review_action": 30, "origin": 10}


def loudest_row(spark, sf_dir):
    level = F.create_map(*[F.lit(x) for pair in LOUDNESS.items() for x in pair])
    rows = memory(spark, sf_dir).withColumn("loud", F.coalesce(level[F.col("signal_type")], F.lit(0))).withColumn("early", -F.col("event_id"))
    return R.best_row(rows, ["topic"], ["loud", "ts", "early"], ["event_id", "signal_type", "memory_value"])


_LOUD = "CASE signal_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LOUDNESS.items()) + " ELSE 0 END"
_RANKED = "row_number() OVER (PARTITION BY topic ORDER BY ts {d}, event_id {d})"

QUERIES = {
    "E2_E7_continuity_packet": (continuity_packet_per_user, _PACKET_SQL),
    "E2_latest_by_role": (latest_by_role, _roles_sql(ROLES, "trust_level = 'trusted'")),
    "E4_product_packet": (product_packet, _roles_sql(PRODUCT, TRUST, "client_id, topic")),
    "B8_scoped_packet": (scoped_packet, _roles_sql(PRODUCT, f"client_id = 'client-2' AND namespace = 'main' AND {TRUST}", "client_id, vault_id, namespace, topic")),
    "E5_account_packet": (
        account_packet,
        f"{M}SELECT topic, "
        + ", ".join(f"coalesce(arg_max(memory_value, {AT}) FILTER (WHERE signal_type = '{s}'), '') AS {s}" for s in ("origin", "current_state", "review_action"))
        + ", "
        + ", ".join(f"count(*) FILTER (WHERE signal_type = '{s}') AS n_{s}" for s in ("risk_signal", "human_context", "counter_evidence"))
        + f" FROM m WHERE {TRUST} GROUP BY topic",
    ),
    "E5_signal_lists": (
        account_signal_lists,
        f"{M}SELECT topic, signal_type, event_id, memory_value, row_number() OVER (PARTITION BY topic, signal_type ORDER BY ts, event_id) AS position "
        f"FROM m WHERE {TRUST} AND signal_type IN ('risk_signal', 'human_context', 'counter_evidence')",
    ),
    "E6_entity_packet": (entity_packet, _ENTITY_SQL),
    "E6_meaningful_changes": (meaningful_changes, f"{M}SELECT topic, event_id, concat(state_before, ' -> ', state_after) AS change FROM m WHERE status = 'active' AND state_before <> state_after"),
    "E7_simple_packet": (
        simple_packet,
        "SELECT conv_id, arg_max(text, turn) AS latest_content, count(*) AS n_events, array_to_string(list_sort(list(DISTINCT role)), ',') AS event_types FROM conversations GROUP BY conv_id",
    ),
    "E8_preferred_row": (
        preferred_row,
        f"{M}SELECT topic, event_id, signal_type, status, memory_value FROM m QUALIFY row_number() OVER (PARTITION BY topic ORDER BY (status = 'active' AND importance = 'high') DESC, ts DESC, event_id DESC) = 1",
    ),
    "K17_K18_action_and_explanation": (
        action_and_explanation,
        f"{M}, p AS ({_ENTITY_SQL[len(M):]}), c AS (SELECT topic, count(*) AS n FROM m WHERE {TRUST} AND signal_type = 'counter_evidence' AND memory_value <> 'Receipt on file' GROUP BY topic) "
        "SELECT topic, coalesce(n, 0) AS n_counter_evidence, CASE WHEN n > 0 THEN 'request_evidence' WHEN active_signals <> '' THEN 'human_review' ELSE 'do_nothing' END AS recommended_action, "
        "n > 0 IS TRUE OR active_signals <> '' AS human_review_required, concat('State moved from ', coalesce(previous_state, 'None'), ' to ', coalesce(current_state, 'None'), '.') AS explanation, "
        "true AS sensitive_details_allowed FROM p LEFT JOIN c USING (topic)",
    ),
    "F6_last_rows": (last_events_per_user, f"{M}SELECT topic, event_id, memory_value, {_RANKED.format(d='DESC')} AS rank FROM m QUALIFY rank <= 3"),
    "F7_first_and_last": (
        first_and_last_events,
        f"{M}SELECT topic, event_id, {_RANKED.format(d='ASC')} AS rank, 'first' AS part FROM m QUALIFY rank <= 20 UNION ALL SELECT topic, event_id, {_RANKED.format(d='DESC')} AS rank, 'last' FROM m QUALIFY rank <= 20",
    ),
    "G2_top_per_group": (
        top_orders_per_customer,
        "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5",
    ),
    "G3_top_overall": (top_orders, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 40"),
    "G6_loudest_row": (loudest_row, f"{M}SELECT topic, event_id, signal_type, memory_value FROM m QUALIFY row_number() OVER (PARTITION BY topic ORDER BY {_LOUD} DESC, ts DESC, event_id) = 1"),
}
