"""Access decisions, quotas and key states over tables of requests, keys, clients, vaults, namespaces and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.neighbours import BUCKET
from loomline.sources.shared import written

#: Operations, and the limit that each counts against.
OPERATIONS = {
    "events_ingest": "max_events",
    "continuity_packet": "max_packets",
    "memory_reconstruct": "max_packets",
    "explain": "max_packets",
    "least_harm_action": "max_packets",
    "report_read": "max_reports",
}
#: Status code of every reason.
CODES = {
    "operation_invalid": 400, "missing_key": 401, "invalid_key": 401, "revoked_key": 403, "rotated_key": 403, "key_client_mismatch": 403, "client_not_found": 404,
    "client_not_active": 403, "vault_denied": 403, "namespace_denied": 403, "usage_limit_exceeded": 429, "allowed": 200,
}
#: The usual order of checks; other surfaces pass their own.
LADDER = ("operation_invalid", "missing_key", "invalid_key", "revoked_key", "rotated_key", "key_client_mismatch", "client_not_found", "client_not_active", "vault_denied", "namespace_denied")


def resolve(requests: DataFrame, keys: DataFrame, clients: DataFrame, vaults: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Requests with what the dimension tables say of their key, client, vault and namespace (nulls where nothing is found).

    requests: client_id, key_hash, vault_id, namespace, operation; keys: key_hash, key_client, key_status; the others have a
    status each. All joins are left lookups on unique keys, so rows never multiply; small dimensions are sent by the optimizer.
    """
    return (
        requests.join(keys, "key_hash", "left")
        .join(clients.select("client_id", "client_status"), "client_id", "left")
        .join(vaults.select("client_id", "vault_id", "vault_status"), ["client_id", "vault_id"], "left")
        .join(namespaces.select("client_id", "vault_id", "namespace", "namespace_status"), ["client_id", "vault_id", "namespace"], "left")
    )


def failures() -> dict[str, Column]:
    """The condition behind every reason, over the columns of resolve()."""
    no = lambda c, v: ~F.coalesce(F.col(c) == v, F.lit(False))
    return {
        "operation_invalid": ~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)),
        "missing_key": F.coalesce(F.col("key_hash"), F.lit("")) == "",
        "invalid_key": F.col("key_status").isNull(),
        "revoked_key": F.col("key_status") == "revoked",
        "rotated_key": F.col("key_status") == "rotated",
        "key_client_mismatch": ~F.col("key_client").eqNullSafe(F.col("client_id")),
        "client_not_found": F.col("client_status").isNull(),
        "client_not_active": no("client_status", "active"),
        "vault_denied": no("vault_status", "active"),
        "namespace_denied": no("namespace_status", "active"),
    }


def decide(resolved: DataFrame, ladder: tuple[str, ...] = LADDER) -> DataFrame:
    """Adds `reason` (the first failing check of the ladder, else allowed), `status_code` and `allowed`; quotas come after."""
    reason, checks = F, failures()
    for name in ladder:
        reason = reason.when(checks[name], name)
    return _coded(resolved.withColumn("reason", reason.otherwise("allowed")))


def _coded(df: DataFrame) -> DataFrame:
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return df.withColumn("status_code", code[F.col("reason")]).withColumn("allowed", F.col("reason") == "allowed")


def operation_limit(limits: Column) -> Column:
    """The number that an operation may use up, from a struct of the three limits."""
    out = F
    for operation, name in OPERATIONS.items():
        out = out.when(F.col("operation") == operation, limits[name])
    return out.otherwise(None)


def admit(decided: DataFrame, limits: DataFrame, order: list[str]) -> DataFrame:
    """Adds the quota's verdict, in the order of requests: one is admitted while what was admitted before plus its count fits.

    limits: client_id, max_events, max_packets, max_reports. With counts of one this is a rank; with any counts, whether a
    request is admitted depends on earlier admissions, see _admitted(). A null count never fits a limit. Where all counts are
    one, use admit_single().
    """
    scope = ["client_id", "vault_id", "namespace", "operation"]
    rows = decided.join(limits, "client_id", "left").withColumn("_max", operation_limit(F.struct("max_events", "max_packets", "max_reports")))
    verdicts = _admitted(rows.where("allowed").select(*scope, *order, "count", "_max"), scope, order).withColumn("_fits", F.lit(True))
    out = rows.join(verdicts, [*scope, *order], "left")
    over = F.col("allowed") & ~F.coalesce(F.col("_fits"), F.lit(False))
    return _coded(out.withColumn("reason", F.when(over, "usage_limit_exceeded").otherwise(F.col("reason")))).drop("_fits", "_max", "max_events", "max_packets", "max_reports")


def _admitted(asking: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """scope and order of the calls that fit.

    In each round the calls of a scope up to the first overflow of its running sum are admitted, and of the later ones those
    that still fit the room left go on. The room falls and the largest count left falls with it, so there are no more rounds
    than distinct counts. Running sums are taken per (scope, range of the order), so a hot scope is spread over many tasks.
    Scopes with a negative count can gain room again; only these are folded call by call.
    """
    columns = [*scope, *order]
    gaining = asking.where("count < 0 AND _max IS NOT NULL").select(*scope).distinct()
    done = [asking.where("_max IS NULL").select(columns)]
    limited = asking.where("count IS NOT NULL AND _max IS NOT NULL")
    if not gaining.isEmpty():
        done.append(_folded(limited.join(gaining, scope, "left_semi"), scope, order))
        limited = limited.join(gaining, scope, "left_anti")
    ranged = limited.where("count <= _max").withColumnRenamed("_max", "_room").repartitionByRange(*columns)
    now = written(ranged.withColumn(BUCKET, F.spark_partition_id()), "asking")
    while not now.isEmpty():
        sizes = now.groupBy(*scope, BUCKET).agg(F.sum("count").alias("_n"))
        earlier = Window.partitionBy(*scope).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.select(*scope, BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        running = F.sum("count").over(Window.partitionBy(*scope, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        judged = written(now.withColumn("_reached", running).join(before, [*scope, BUCKET]).withColumn("_reached", F.col("_reached") + F.col("_before")).drop("_before"), "judged")
        done.append(judged.where("_reached <= _room").select(columns))
        taken = judged.where("_reached <= _room").groupBy(*scope).agg(F.max("_reached").alias("_taken"))
        left = judged.where("_reached > _room").drop("_reached").join(taken, scope, "left")
        now = written(left.withColumn("_room", F.col("_room") - F.coalesce("_taken", F.lit(0))).drop("_taken").where("count <= _room"), "asking")
    return reduce(DataFrame.union, done)


def _folded(asking: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """scope and order of the calls that fit, a scope's calls folded one by one in one array."""
    calls = F.array_sort(F.collect_list(F.struct(*order, "count")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, call: Column) -> Column:
        fits = acc["used"] + call["count"] <= F.col("_max")
        return F.struct((acc["used"] + F.when(fits, call["count"]).otherwise(0)).alias("used"), F.concat(acc["ok"], F.array(fits)).alias("ok"))

    folded = asking.groupBy(*scope, "_max").agg(calls.alias("calls")).withColumn("ok", F.aggregate("calls", start, step)["ok"])
    verdicts = folded.select(*scope, F.explode(F.arrays_zip("calls", "ok")).alias("x")).where("x.ok")
    return verdicts.select(*scope, *[F.col(f"x.calls.{c}").alias(c) for c in order])


def admit_single(decided: DataFrame, limits: DataFrame, order: list[str]) -> DataFrame:
    """admit() for requests that count one each: the first `limit` allowed requests of a scope and operation pass."""
    scope = ["client_id", "vault_id", "namespace", "operation"]
    rows = decided.join(limits, "client_id", "left").withColumn("_max", operation_limit(F.struct("max_events", "max_packets", "max_reports")))
    rank = F.row_number().over(Window.partitionBy(*scope, "allowed").orderBy(*order))
    over = F.col("allowed") & F.col("_max").isNotNull() & (rank > F.col("_max"))
    return _coded(rows.withColumn("reason", F.when(over, "usage_limit_exceeded").otherwise(F.col("reason")))).drop("_max", "max_events", "max_packets", "max_reports")


def current_status(log: DataFrame, keys: list[str], status: str = "status", seq: str = "seq") -> DataFrame:
    """Latest status of each key of an append-only state log, with the number of changes and whether it was ever revoked."""
    return log.groupBy(*keys).agg(F.max_by(status, seq).alias("current_status"), F.count(F.lit(1)).alias("n_changes"), F.max(F.col(status) == "revoked").alias("was_revoked"))


def owned(items: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Items inside the given scopes."""
    return items.join(scopes.select(*keys).distinct(), keys, "left_semi")


def foreign(items: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Items outside all given scopes: empty if tenants are kept apart."""
    return items.join(scopes.select(*keys).distinct(), keys, "left_anti")


def bearer(header: Column) -> Column:
    """The key of an authorization header; null if it has another form."""
    key = F.regexp_extract(header, r"^Bearer\s+(\S+)\s*$", 1)
    return F.when(key != "", key)
