"""Usage summaries, quotas used, counts for dashboards and joins of requests with reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_summary(usage: DataFrame) -> DataFrame:
    """Sum of counts and rows allowed and blocked: by client, by vault, by scope and over all, in one pass.

    usage: client_id, vault_id, namespace, count, allowed. `level` names the grouping.
    """
    grouped = usage.groupingSets([["client_id"], ["vault_id"], ["client_id", "vault_id", "namespace"], []], "client_id", "vault_id", "namespace")
    out = grouped.agg(F.grouping_id().alias("_g"), F.sum("count").alias("total"), F.count_if("allowed").alias("allowed_rows"), F.count_if(~F.col("allowed")).alias("blocked_rows"))
    level = F.when(F.col("_g") == 0b011, "client").when(F.col("_g") == 0b101, "vault").when(F.col("_g") == 0, "scope").otherwise("all")
    return out.select(level.alias("level"), "client_id", "vault_id", "namespace", "total", "allowed_rows", "blocked_rows")


def used_quota(usage: DataFrame, since: Column | None = None) -> DataFrame:
    """Allowed counts by scope and operation; all time, or from a moment on."""
    rows = usage.where("allowed") if since is None else usage.where(F.col("allowed") & since)
    return rows.groupBy("client_id", "vault_id", "namespace", "operation").agg(F.sum("count").alias("used"))


def client_overview(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Requests, allowed and blocked, distinct blocked reasons and the last status of each client."""
    blocked = ~F.col("allowed")
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("allowed").alias("allowed_rows"),
        F.count_if(blocked).alias("blocked_rows"),
        F.array_join(F.array_sort(F.collect_set(F.when(blocked, F.col("reason")))), ",").alias("blocked_reasons"),
        F.max_by("status_code", F.struct(*order)).alias("last_status"),
    )


def counts_with_zeros(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows of each allowed value, zero where there are none."""
    values = rows.sparkSession.createDataFrame([(v,) for v in allowed], f"{column} string")
    found = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return values.join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def scope_activity(namespaces: DataFrame, keys: list[str], **facts: DataFrame) -> DataFrame:
    """Every namespace with its number of rows in each fact table, zero where there are none."""
    out = namespaces
    for name, rows in facts.items():
        out = out.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    return out.fillna(0, list(facts))


def health(requests: DataFrame) -> DataFrame:
    """One row: sums and which kinds of operation have been seen."""
    seen = lambda o: F.coalesce(F.bool_or(F.col("operation") == o), F.lit(False))
    return requests.agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("count"), F.lit(0)).alias("events"), F.count_if(~F.col("allowed")).alias("blocked"), seen("events_ingest").alias("ingest_seen"), seen("report_read").alias("report_seen")
    )


def with_review(requests: DataFrame, reviews: DataFrame, key: str, seq: str, columns: list[str], last: bool = True) -> DataFrame:
    """Requests with their last (or first) review; nulls where there is none."""
    pick = F.max_by if last else F.min_by
    one = reviews.groupBy(key).agg(pick(F.struct(*columns), seq).alias("_review"))
    return requests.join(one, key, "left").select("*", *[F.col(f"_review.{c}").alias(c) for c in columns]).drop("_review")


def review_history(changes: DataFrame, keys: list[str], seq: str, status: str) -> DataFrame:
    """Every status change with the status it replaced."""
    own = Window.partitionBy(*keys).orderBy(seq)  # one request's changes, a handful
    return changes.withColumn("from_status", F.lag(status).over(own)).withColumnRenamed(status, "to_status")


def dashboard_state(requests: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """One row per client: requests allowed and blocked, sorted blocked reasons, visible reports and which results exist."""
    blocked = ~F.col("allowed")
    seen = lambda o: F.coalesce(F.bool_or(F.col("operation") == o), F.lit(False))
    state = requests.groupBy(*keys).agg(
        F.count_if("allowed").alias("allowed_requests"),
        F.count_if(blocked).alias("blocked_requests"),
        F.array_join(F.array_sort(F.collect_set(F.when(blocked, F.col("reason")))), ",").alias("blocked_reasons"),
        seen("memory_reconstruct").alias("reconstruction_available"),
        seen("explain").alias("explanation_available"),
    )
    visible = reports.groupBy(*keys).agg(F.count(F.lit(1)).alias("reports_visible"))
    return state.join(visible, keys, "left").fillna(0, ["reports_visible"])


def is_true(column: Column) -> Column:
    """True only for true: null and false are false."""
    return F.coalesce(column, F.lit(False)) == F.lit(True)


def route_results(results: DataFrame, body: str = "body") -> DataFrame:
    """name, status_code, status, operation, error_code and public_safe of nested results; a missing body or error gives nulls."""
    own = F.col(body)
    return results.select("name", "status_code", own["status"].alias("status"), own["operation"].alias("operation"), own["error"]["code"].alias("error_code"), own["public_safe"].alias("public_safe"))


def stamped(reports: DataFrame, context: dict[str, Column], results: str, version: Column) -> DataFrame:
    """Reports with constant columns of their context, and the version in each of their nested results."""
    return reports.withColumns({**context, "version": version, results: F.transform(results, lambda r: r.withField("version", version))})


def public_decisions(decisions: DataFrame, private: bool = False) -> DataFrame:
    """The columns of a decision that a public report shows, rounded to two places; the private one adds all sizes and the reason."""
    raw, own = F.col("raw_size"), F.col("policy_size")
    ratio = F.when(own != 0, F.bround(raw / own, 2))
    shown = ["dataset", F.col("n").alias("input_rows"), raw.alias("baseline_size"), own.alias("encoded_size"), F.col("policy_mode").alias("mode"), F.bround(F.when(raw != 0, (raw - own) / raw * 100).otherwise(0.0), 2).alias("reduction_percent"), ratio.alias("ratio")]
    return decisions.select(*shown, *(["transform_size", "dictionary_size", "rule_size", "reason"] if private else []))
