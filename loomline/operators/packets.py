"""Continuity packets: the latest trusted state of each topic, account or entity, by aggregation alone.

Every packet is one groupBy whose aggregates are combined before the shuffle, so a topic with very many rows costs
one partial row per task. `order` names the columns that order a topic's rows (time, then row number): among equal times the later
row is the newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import numbered

#: Rows that may speak for a topic.
TRUSTED, SPEAKING = "trusted", ("active", "historical")


def newest(value: Column, order: list[str], where: Column | None = None) -> Column:
    """The value of the newest row (among those that meet a condition; null without one)."""
    at = F.struct(*order)
    return F.max_by(value, at if where is None else F.when(where, at))


def oldest(value: Column, order: list[str], where: Column | None = None) -> Column:
    at = F.struct(*order)
    return F.min_by(value, at if where is None else F.when(where, at))


def trusted_rows(df: DataFrame, statuses: tuple[str, ...] = SPEAKING) -> DataFrame:
    """Rows of trusted origin that are active or historical."""
    return df.where((F.col("trust_level") == TRUSTED) & F.col("status").isin(*statuses))


def in_scope(df: DataFrame, client: str | None = None, vault: str | None = None, namespace: str | None = None) -> DataFrame:
    """Rows of a scope; parts that are not given do not narrow it. Apply first: it reaches the scan."""
    for column, wanted in (("client_id", client), ("vault_id", vault), ("namespace", namespace)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


def by_role(df: DataFrame, role: str | tuple[str, ...], statuses: tuple[str, ...] = (), trust: tuple[str, ...] = (), column: str = "signal_type") -> DataFrame:
    """Rows of a role; empty sets of statuses or trust levels do not narrow them."""
    df = df.where(F.col(column).isin(*([role] if isinstance(role, str) else role)))
    if statuses:
        df = df.where(F.col("status").isin(*statuses))
    return df.where(F.col("trust_level").isin(*trust)) if trust else df


def latest_by_role(df: DataFrame, keys: list[str], order: list[str], outputs: dict[str, tuple[str, ...]], value: str = "memory_value", role: str = "signal_type", empty: str | None = None) -> DataFrame:
    """One row per key with, for each output, the newest value among rows of its roles."""
    found = [newest(F.col(value), order, F.col(role).isin(*roles)).alias(name) for name, roles in outputs.items()]
    out = df.groupBy(*keys).agg(*found)
    return out if empty is None else out.fillna(empty, list(outputs))


def signal_list(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str = "memory_value", role: str = "signal_type") -> DataFrame:
    """All values of each role in order, one row each with its position: lists that no single task has to hold."""
    return numbered(df.select(*keys, role, *order, value), [*keys, role], order, bucket)


def account_packet(df: DataFrame, keys: list[str], order: list[str], latest: tuple[str, ...], listed: tuple[str, ...]) -> DataFrame:
    """Newest value of the `latest` signals (empty text if none) and size of each list; the lists are signal_list()."""
    rows = trusted_rows(df)
    aggs = [F.coalesce(newest(F.col("memory_value"), order, F.col("signal_type") == s), F.lit("")).alias(s) for s in latest]
    aggs += [F.count_if(F.col("signal_type") == s).alias(f"n_{s}") for s in listed]
    return rows.groupBy(*keys).agg(*aggs)


def entity_packet(df: DataFrame, keys: list[str], order: list[str], current_types: tuple[str, ...]) -> DataFrame:
    """State before and after, sets of active and stale signals, and number of changes of each entity.

    Current: state after of the newest active row of a current type, else of the newest active row. Previous: state before of
    that current-type row, else of the entity's first row of any status.
    """
    active, stale = F.col("status") == "active", F.col("status") == "stale"
    current = active & F.col("event_type").isin(*current_types)
    has = F.max(current)
    names = lambda where: F.array_sort(F.collect_set(F.when(where & (F.col("signal_type") != ""), F.col("signal_type"))))
    return df.groupBy(*keys).agg(
        F.when(has, newest(F.col("state_after"), order, current)).otherwise(newest(F.col("state_after"), order, active)).alias("current_state"),
        F.when(has, newest(F.col("state_before"), order, current)).otherwise(oldest(F.col("state_before"), order)).alias("previous_state"),
        F.count_if(active & ~F.col("state_before").eqNullSafe(F.col("state_after"))).alias("n_changes"),
        F.array_join(names(active), ",").alias("active_signals"),
        F.array_join(names(stale), ",").alias("stale_signals"),
        F.count(F.lit(1)).alias("n_events"),
    )


def meaningful_changes(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A row 'before -> after' for every active event that changed something."""
    moved = (F.col("status") == "active") & ~F.col("state_before").eqNullSafe(F.col("state_after"))
    return df.where(moved).select(*keys, *order, F.concat(F.coalesce("state_before", F.lit("None")), F.lit(" -> "), F.coalesce("state_after", F.lit("None"))).alias("change"))


def simple_packet(df: DataFrame, keys: list[str], order: list[str], content: str, kind: str) -> DataFrame:
    """Newest content, number of events and sorted kinds of each key."""
    return df.groupBy(*keys).agg(newest(F.col(content), order).alias("latest_content"), F.count(F.lit(1)).alias("n_events"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("event_types"))


def preferred_row(df: DataFrame, keys: list[str], order: list[str], preferred: Column, columns: list[str]) -> DataFrame:
    """The newest preferred row of each key, else its newest row."""
    best = F.max_by(F.struct(*columns), F.struct(F.coalesce(preferred, F.lit(False)), *order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in columns])


def least_harm_action(packets: DataFrame, counter: str = "n_counter_evidence", signals: str = "active_signals") -> DataFrame:
    """The mildest action that a packet calls for."""
    action = F.when(F.col(counter) > 0, "request_evidence").when(F.length(signals) > 0, "human_review").otherwise("do_nothing")
    return packets.withColumn("recommended_action", action).withColumn("human_review_required", action != "do_nothing")


def explanation(packets: DataFrame, audience: str) -> DataFrame:
    """What a packet may tell: the internal audience sees states, all others a neutral notice."""
    if audience == "internal":
        text = F.concat(F.lit("State moved from "), F.coalesce("previous_state", F.lit("None")), F.lit(" to "), F.coalesce("current_state", F.lit("None")), F.lit("."))
        return packets.withColumn("explanation", text).withColumn("sensitive_details_allowed", F.lit(True))
    return packets.withColumn("explanation", F.lit("Some activity may need a review before continuing.")).withColumn("sensitive_details_allowed", F.lit(False))
