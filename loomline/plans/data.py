"""The driver tables as the library's data model, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events as topic memory: user = topic, event type = signal, the number in props decides status, trust and wording.
MEMORY = """
SELECT event_id, ts, topic, client_id, vault_id, namespace, event_type, signal_type, k,
  CASE WHEN k % 10 < 6 THEN 'active' WHEN k % 10 < 8 THEN 'historical' ELSE 'stale' END AS status,
  CASE WHEN k >= 80 THEN 'untrusted' ELSE 'trusted' END AS trust_level,
  CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS importance,
  CASE k % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'held' WHEN 2 THEN 'open' WHEN 3 THEN 'cleared' ELSE 'closed' END AS state_before,
  CASE k % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'held' WHEN 2 THEN 'cleared' ELSE 'closed' END AS state_after,
  CASE
    WHEN signal_type = 'risk_signal' THEN CASE k % 6 WHEN 0 THEN 'Device continuity broke on login' WHEN 1 THEN 'Coordinated pattern across accounts'
      WHEN 2 THEN 'Rapid dispersal of funds' WHEN 3 THEN 'Suspicious deposits seen' WHEN 4 THEN 'Large unusual incoming payment' ELSE 'New recipient added' END
    WHEN signal_type = 'human_context' THEN CASE k % 8 WHEN 0 THEN 'Customer did not authorize it' WHEN 1 THEN 'Coached by caller on the phone'
      WHEN 2 THEN 'Messages suggest pressure' ELSE 'Customer spoke to an agent' END
    WHEN signal_type = 'counter_evidence' THEN CASE k % 9 WHEN 0 THEN 'Documented student finance' WHEN 1 THEN 'No clear victim found' ELSE 'Receipt on file' END
    WHEN signal_type = 'current_state' THEN CASE k % 11 WHEN 0 THEN 'Ordinary spending continues' ELSE concat('State ', CAST(k AS STRING)) END
    WHEN signal_type = 'review_action' THEN 'Review action: likely false positive'
    ELSE concat('Opened with plan ', CAST(k AS STRING)) END AS memory_value
FROM (
  SELECT event_id, ts, user_id AS topic, concat('client-', CAST(user_id % 5 AS STRING)) AS client_id, concat('vault-', CAST(user_id % 3 AS STRING)) AS vault_id,
    CASE WHEN event_type = 'error' THEN 'ops' ELSE 'main' END AS namespace, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    CASE WHEN event_type = 'signup' THEN 'origin' WHEN event_type = 'click' AND event_id % 13 = 0 THEN 'review_action' WHEN event_type = 'click' THEN 'current_state'
      WHEN event_type = 'view' THEN 'human_context' WHEN event_type = 'purchase' THEN 'counter_evidence' ELSE 'risk_signal' END AS signal_type
  FROM {events}) AS e
"""
#: The same as the first table expression of a DuckDB query.
M = "WITH m AS (" + MEMORY.replace("{events}", "events") + ")\n"


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEMORY over the events, with the number in props read once a row."""
    events = once(table(spark, sf_dir, "events"), k=F.expr(_K))
    return spark.sql(MEMORY.replace(f"{_K} AS k", "k"), events=events)
