"""Access, quota, ownership, usage and dashboard queries: events are requests, customers' regions and nations are scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import access, usage

from .data import table

#: Requests, and what the dimension tables know, in SQL that both engines read.
REQUESTS = """
SELECT event_id, ts, CAST(user_id % 7 AS INT) AS client_id, concat('v', CAST(user_id % 3 AS STRING)) AS vault_id, CASE WHEN event_id % 11 = 0 THEN 'old' ELSE 'main' END AS namespace,
  CASE event_type WHEN 'click' THEN 'events_ingest' WHEN 'view' THEN 'continuity_packet' WHEN 'purchase' THEN 'report_read' WHEN 'signup' THEN 'explain' ELSE CASE WHEN event_id % 5 = 0 THEN 'drop_all' ELSE 'memory_reconstruct' END END AS operation,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('key-', CAST(CASE WHEN event_id % 19 = 0 THEN (user_id + 1) % 7 WHEN event_id % 23 = 0 THEN 99 ELSE user_id % 7 END AS STRING)) END AS key_hash,
  CAST(1 + event_id % 3 AS BIGINT) AS count
FROM {events}"""
KEYS = "SELECT concat('key-', CAST(n_nationkey AS STRING)) AS key_hash, n_nationkey AS key_client, CASE n_nationkey WHEN 4 THEN 'revoked' WHEN 5 THEN 'rotated' ELSE 'active' END AS key_status FROM {nation} WHERE n_nationkey < 7"
CLIENTS = "SELECT n_nationkey AS client_id, CASE n_nationkey WHEN 3 THEN 'suspended' ELSE 'active' END AS client_status FROM {nation} WHERE n_nationkey < 7 AND n_nationkey <> 2"
VAULTS = "SELECT n_nationkey AS client_id, concat('v', CAST(r_regionkey AS STRING)) AS vault_id, CASE WHEN n_nationkey = 1 AND r_regionkey = 2 THEN 'closed' ELSE 'active' END AS vault_status FROM {nation} JOIN {region} ON r_regionkey < 3 WHERE n_nationkey < 7"
NAMESPACES = "SELECT n_nationkey AS client_id, concat('v', CAST(r_regionkey AS STRING)) AS vault_id, 'main' AS namespace, 'active' AS namespace_status FROM {nation} JOIN {region} ON r_regionkey < 3 WHERE n_nationkey < 7"
LIMITS = "SELECT n_nationkey AS client_id, CAST(200 AS BIGINT) AS max_events, CAST(90 AS BIGINT) AS max_packets, CAST(50 AS BIGINT) AS max_reports FROM {nation} WHERE n_nationkey < 7"
PARTS = {"requests": REQUESTS, "keys": KEYS, "clients": CLIENTS, "vaults": VAULTS, "namespaces": NAMESPACES, "limits": LIMITS}


def part(spark, sf_dir, name):
    sql = PARTS[name]
    tables = {t: table(spark, sf_dir, t) for t in ("events", "nation", "region") if "{" + t + "}" in sql}
    return spark.sql(sql, **tables)


_WITH = "WITH " + ", ".join(f"{n} AS ({q.replace('{', '').replace('}', '')})" for n, q in PARTS.items())
_OPS = ", ".join(f"'{o}'" for o in access.OPERATIONS)
_CODE = "CASE reason " + " ".join(f"WHEN '{r}' THEN {c}" for r, c in access.CODES.items()) + " END"
_DECIDED = f"""{_WITH},
resolved AS (SELECT r.*, key_client, key_status, client_status, vault_status, namespace_status FROM requests r LEFT JOIN keys USING (key_hash) LEFT JOIN clients c ON c.client_id = r.client_id
  LEFT JOIN vaults v ON v.client_id = r.client_id AND v.vault_id = r.vault_id LEFT JOIN namespaces n ON n.client_id = r.client_id AND n.vault_id = r.vault_id AND n.namespace = r.namespace),
decided AS (SELECT *, reason = 'allowed' AS allowed, {_CODE} AS status_code FROM (SELECT *, CASE WHEN operation NOT IN ({_OPS}) THEN 'operation_invalid' WHEN key_hash = '' THEN 'missing_key' WHEN key_status IS NULL THEN 'invalid_key'
  WHEN key_status = 'revoked' THEN 'revoked_key' WHEN key_status = 'rotated' THEN 'rotated_key' WHEN key_client <> client_id THEN 'key_client_mismatch' WHEN client_status IS NULL THEN 'client_not_found'
  WHEN client_status <> 'active' THEN 'client_not_active' WHEN vault_status IS NULL OR vault_status <> 'active' THEN 'vault_denied' WHEN namespace_status IS NULL THEN 'namespace_denied' ELSE 'allowed' END AS reason FROM resolved))"""


def decided(spark, sf_dir):
    return access.decide(access.resolve(*[part(spark, sf_dir, n) for n in ("requests", "keys", "clients", "vaults", "namespaces")]))


def access_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("event_id", "reason", "status_code", "allowed")


def other_ladder(spark, sf_dir):
    rows = access.resolve(*[part(spark, sf_dir, n) for n in ("requests", "keys", "clients", "vaults", "namespaces")])
    return access.decide(rows, ("revoked_key", "missing_key", "invalid_key", "client_not_active", "vault_denied")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def quota_fold(spark, sf_dir):
    return access.admit(decided(spark, sf_dir), part(spark, sf_dir, "limits"), ["event_id"]).select("event_id", "reason", "status_code", "allowed")


def quota_rank(spark, sf_dir):
    return access.admit_single(decided(spark, sf_dir), part(spark, sf_dir, "limits"), ["event_id"]).select("event_id", "reason", "allowed")


_LIMIT = "CASE operation WHEN 'events_ingest' THEN max_events WHEN 'report_read' THEN max_reports ELSE max_packets END"
_RANKED = f"""{_DECIDED}, q AS (SELECT d.*, {_LIMIT} AS lim, row_number() OVER (PARTITION BY d.client_id, vault_id, namespace, operation, allowed ORDER BY event_id) AS rk FROM decided d LEFT JOIN limits ON limits.client_id = d.client_id)
SELECT event_id, CASE WHEN allowed AND rk > lim THEN 'usage_limit_exceeded' ELSE reason END AS reason, allowed AND rk <= lim AS allowed FROM q"""
_FOLDED = f"""{_DECIDED}, q AS (SELECT d.*, {_LIMIT} AS lim, row_number() OVER (PARTITION BY d.client_id, vault_id, namespace, operation ORDER BY event_id) AS rk FROM decided d JOIN limits ON limits.client_id = d.client_id WHERE allowed),
f AS (WITH RECURSIVE w AS (
  SELECT event_id, client_id, vault_id, namespace, operation, rk, lim, CASE WHEN count <= lim THEN count ELSE 0 END AS used, count <= lim AS ok FROM q WHERE rk = 1
  UNION ALL SELECT q.event_id, q.client_id, q.vault_id, q.namespace, q.operation, q.rk, q.lim, w.used + CASE WHEN w.used + q.count <= q.lim THEN q.count ELSE 0 END, w.used + q.count <= q.lim
  FROM w JOIN q ON q.client_id = w.client_id AND q.vault_id = w.vault_id AND q.namespace = w.namespace AND q.operation = w.operation AND q.rk = w.rk + 1) SELECT * FROM w),
g AS (SELECT d.event_id, CASE WHEN d.allowed AND NOT f.ok THEN 'usage_limit_exceeded' ELSE d.reason END AS reason FROM decided d LEFT JOIN f USING (event_id))
SELECT event_id, reason, {_CODE} AS status_code, reason = 'allowed' AS allowed FROM g"""


def usage_by_level(spark, sf_dir):
    return usage.usage_summary(decided(spark, sf_dir))


def quota_used(spark, sf_dir):
    return usage.used_quota(decided(spark, sf_dir))


def client_overview(spark, sf_dir):
    return usage.client_overview(decided(spark, sf_dir), ["client_id"], ["ts", "event_id"])


def reason_counts(spark, sf_dir):
    return usage.counts_with_zeros(decided(spark, sf_dir), "reason", [*access.CODES, "never_seen"])


def activity(spark, sf_dir):
    rows = decided(spark, sf_dir)
    keys = ["client_id", "vault_id", "namespace"]
    return usage.scope_activity(part(spark, sf_dir, "namespaces").select(*keys), keys, events=rows.where("operation = 'events_ingest'"), packets=rows.where("operation = 'continuity_packet'"), reports=rows.where("operation = 'report_read'"))


def health(spark, sf_dir):
    return usage.health(decided(spark, sf_dir))


def ownership(spark, sf_dir):
    keys = ["client_id", "vault_id", "namespace"]
    rows, scopes = part(spark, sf_dir, "requests"), part(spark, sf_dir, "namespaces")
    inside = access.owned(rows, scopes, keys).select("event_id", F.lit("owned").alias("kind"))
    return inside.unionByName(access.foreign(rows, scopes, keys).select("event_id", F.lit("foreign").alias("kind")))


def key_states(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key_id"), F.when(F.col("o_orderstatus") == "F", "revoked").when(F.col("o_orderstatus") == "P", "suspended").otherwise("active").alias("status"), F.col("o_orderkey").alias("seq"))
    return access.current_status(log, ["key_id"])


def reviews_last(spark, sf_dir):
    return _reviewed(spark, sf_dir, True)


def reviews_first(spark, sf_dir):
    return _reviewed(spark, sf_dir, False)


def _reviewed(spark, sf_dir, last):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return usage.with_review(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus"], last)


def status_history(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return usage.review_history(changes, ["o_custkey"], "o_orderkey", "o_orderstatus")


_LEVELS = [("client", "client_id", "NULL", "NULL"), ("vault", "NULL", "vault_id", "NULL"), ("scope", "client_id", "vault_id", "namespace"), ("all", "NULL", "NULL", "NULL")]
_SUMMARY = " UNION ALL ".join(
    f"SELECT '{n}' AS level, CAST({c} AS INT) AS client_id, CAST({v} AS VARCHAR) AS vault_id, CAST({s} AS VARCHAR) AS namespace, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (WHERE allowed) AS allowed_rows, count(*) FILTER (WHERE NOT allowed) AS blocked_rows FROM decided"
    + (" GROUP BY " + ", ".join(x for x in (c, v, s) if x != "NULL") if n != "all" else "")
    for n, c, v, s in _LEVELS
)
_ONE = "SELECT c_custkey, c_name, r.o_orderkey, r.o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, {f}(o_orderkey, o_orderkey) AS o_orderkey, {f}(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey) r ON r.o_custkey = c_custkey"

QUERIES = {
    "K1_access_decision": (access_decisions, f"{_DECIDED} SELECT event_id, reason, status_code, allowed FROM decided"),
    "K2_other_ladder": (
        other_ladder,
        f"{_DECIDED} SELECT CASE WHEN key_status = 'revoked' THEN 'revoked_key' WHEN key_hash = '' THEN 'missing_key' WHEN key_status IS NULL THEN 'invalid_key' "
        "WHEN client_status IS NULL OR client_status <> 'active' THEN 'client_not_active' WHEN vault_status IS NULL OR vault_status <> 'active' THEN 'vault_denied' ELSE 'allowed' END AS reason, count(*) AS n FROM resolved GROUP BY 1",
    ),
    "K3_quota_fold": (quota_fold, _FOLDED),
    "K3_quota_rank": (quota_rank, _RANKED),
    "K4_key_states": (
        key_states,
        "SELECT o_custkey AS key_id, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 'revoked' WHEN 'P' THEN 'suspended' ELSE 'active' END AS current_status, count(*) AS n_changes, bool_or(o_orderstatus = 'F') AS was_revoked FROM orders GROUP BY 1",
    ),
    "C8_C15_ownership": (ownership, f"{_WITH} SELECT r.event_id, CASE WHEN n.client_id IS NULL THEN 'foreign' ELSE 'owned' END AS kind FROM requests r LEFT JOIN namespaces n ON n.client_id = r.client_id AND n.vault_id = r.vault_id AND n.namespace = r.namespace"),
    "E9_usage_summary": (usage_by_level, f"{_DECIDED} {_SUMMARY}"),
    "E11_used_quota": (quota_used, f"{_DECIDED} SELECT client_id, vault_id, namespace, operation, CAST(sum(count) AS BIGINT) AS used FROM decided WHERE allowed GROUP BY ALL"),
    "E10_client_overview": (
        client_overview,
        f"{_DECIDED} SELECT client_id, count(*) AS requests, count(*) FILTER (WHERE allowed) AS allowed_rows, count(*) FILTER (WHERE NOT allowed) AS blocked_rows, "
        "coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (WHERE NOT allowed)), ','), '') AS blocked_reasons, arg_max(status_code, {'t': ts, 'o': event_id}) AS last_status FROM decided GROUP BY client_id",
    ),
    "E17_counts_with_zeros": (
        reason_counts,
        f"{_DECIDED}, v AS (SELECT unnest([{', '.join(repr(r) for r in [*access.CODES, 'never_seen'])}]) AS reason) SELECT v.reason, count(d.reason) AS n FROM v LEFT JOIN decided d ON d.reason = v.reason GROUP BY v.reason",
    ),
    "C6_scope_activity": (
        activity,
        f"{_DECIDED} SELECT n.client_id, n.vault_id, n.namespace, count(*) FILTER (WHERE operation = 'events_ingest') AS events, count(*) FILTER (WHERE operation = 'continuity_packet') AS packets, "
        "count(*) FILTER (WHERE operation = 'report_read') AS reports FROM namespaces n LEFT JOIN decided d ON n.client_id = d.client_id AND n.vault_id = d.vault_id AND n.namespace = d.namespace GROUP BY ALL",
    ),
    "E14_health": (
        health,
        f"{_DECIDED} SELECT count(*) AS requests, CAST(sum(count) AS BIGINT) AS events, count(*) FILTER (WHERE NOT allowed) AS blocked, bool_or(operation = 'events_ingest') AS ingest_seen, bool_or(operation = 'report_read') AS report_seen FROM decided",
    ),
    "C4_last_review": (reviews_last, _ONE.format(f="arg_max")),
    "C5_first_review": (reviews_first, _ONE.format(f="arg_min")),
    "K33_status_history": (status_history, "SELECT o_custkey, o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS from_status, o_orderstatus AS to_status FROM orders"),
}
