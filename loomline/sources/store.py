"""A store of keyed tables as Parquet: append, newest row per key, scoped scans, snapshots.

Rows are only ever appended, each with a sequence number; reading keeps the newest row of a key. So a repeated batch or a
retried task changes nothing, and no table is rewritten for one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables with their keys; scoped keys throughout, so no tenant can overwrite another's rows.
SCOPE = ["client_id", "vault_id", "namespace"]
TABLE_KEYS = {
    "clients": ["client_id"],
    "limits": ["client_id"],
    "vaults": ["client_id", "vault_id"],
    "namespaces": SCOPE,
    "keys": ["key_id"],
    "events": [*SCOPE, "event_id"],
    "packets": [*SCOPE, "packet_id"],
    "reconstructions": [*SCOPE, "reconstruction_id"],
    "explanations": [*SCOPE, "explanation_id"],
    "reports": [*SCOPE, "report_id"],
    "usage": [*SCOPE, "usage_id"],
    "requests": ["client_id", "request_id"],
    "refreshes": ["refresh_id"],
}
HIDDEN = ("key_hash",)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upserted(base: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest row of every key of both tables."""
    return newest_rows(base.unionByName(batch), keys, seq)


def newest_rows(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def scan(rows: DataFrame, order: list[str], **equal: str | None) -> DataFrame:
    """Rows whose columns equal the given values (None does not narrow), in order."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order) if order else rows


def lookup(rows: DataFrame, **equal) -> DataFrame:
    """The row of a full key."""
    return scan(rows, [], **equal).limit(1) if equal else rows.limit(0)


def latest(rows: DataFrame, created: str, identity: str) -> DataFrame:
    return rows.orderBy(F.desc(created), F.desc(identity)).limit(1)


def snapshot(tables: dict[str, DataFrame], public: bool = True) -> dict[str, DataFrame]:
    """Every table in key order; without hidden columns if it is for the public."""
    out = {}
    for name, rows in tables.items():
        keys = [k for k in TABLE_KEYS.get(name, rows.columns[:1]) if k in rows.columns]
        out[name] = (rows.drop(*HIDDEN) if public else rows).orderBy(*keys)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of every table."""
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, rows in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def schemas(tables: dict[str, DataFrame]) -> dict[str, str]:
    return {name: rows.schema.simpleString() for name, rows in tables.items()}


def create_tables(spark: SparkSession, ddl: dict[str, str], reset: bool = False) -> None:
    """Catalog tables, made if they are not there."""
    for name, columns in ddl.items():
        if reset:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
