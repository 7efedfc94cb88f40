"""Row shaping: sanitizing, strict and lenient event projections, filters of consoles, and public views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import lowered, slug, truncated

#: Fields of a memory row with length and default; fields of a strict event with their length.
ROW_FIELDS = {"text": (1000, ""), "memory_value": (1000, ""), "topic": (120, "unknown"), "signal_type": (80, "note"), "status": (80, "active"), "trust_level": (80, "trusted")}
EVENT_FIELDS = {
    "event_id": 120, "entity_id": 120, "entity_type": 80, "timestamp": 80, "event_type": 80, "state_before": 1000, "state_after": 1000, "signal_type": 80, "status": 80, "trust_level": 80,
}
MAX_BATCH = 500


def sanitized(rows: DataFrame, position: Column | None = None) -> DataFrame:
    """Known text fields cut and defaulted, others kept; a missing time becomes the row's position (from 1)."""
    made = {c: truncated(F.col(c) if c in rows.columns else F.lit(None), n, default) for c, (n, default) in ROW_FIELDS.items()}
    out = rows.withColumns(made)
    if position is not None:
        time = F.col("timestamp_index") if "timestamp_index" in rows.columns else F.lit(None).cast("long")
        out = out.withColumn("timestamp_index", F.coalesce(time, position))
    return out


def event_problem(fields: dict[str, int] | None = None) -> Column:
    """The required fields that an event lacks, joined; empty for a sound one."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in (fields or EVENT_FIELDS)])


def strict_events(rows: DataFrame, batch: list[str], fields: dict[str, int] | None = None, most: int = MAX_BATCH) -> DataFrame:
    """Events of sound batches, with required fields only, cut to length. One bad row or too many rows reject their batch."""
    fields = fields or EVENT_FIELDS
    verdict = batch_verdicts(rows, batch, fields, most).where("verdict = 'accepted'").select(*batch)
    return rows.join(verdict, batch, "left_semi").select(*batch, *[F.substring(F.col(c).cast("string"), 1, n).alias(c) for c, n in fields.items() if c not in batch])


def batch_verdicts(rows: DataFrame, batch: list[str], fields: dict[str, int] | None = None, most: int = MAX_BATCH) -> DataFrame:
    """What becomes of each batch, and its rows."""
    bad = F.count_if(event_problem(fields) != "")
    return rows.groupBy(*batch).agg(F.count(F.lit(1)).alias("n"), bad.alias("n_bad")).select(*batch, "n", "n_bad", F.when(F.col("n") > most, "payload_too_large").when(F.col("n_bad") > 0, "missing_fields").otherwise("accepted").alias("verdict"))


def lenient_events(rows: DataFrame, identity: Column) -> DataFrame:
    """Events with defaults for what is missing; ids are given by the caller, so that a retried batch gets the same."""
    return rows.select(
        F.substring(F.coalesce(F.col("event_id").cast("string"), identity), 1, 120).alias("event_id"),
        truncated(F.col("user_id"), 120, "unknown").alias("user_id"),
        truncated(F.col("type"), 120, "event").alias("type"),
        truncated(F.col("content"), 1200, "").alias("content"),
    )


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of a summary under its own names."""
    return rows.select(*[F.col(old).alias(new) for old, new in names.items()])


def aliased(column: Column, aliases: dict[str, str]) -> Column:
    """An id by its alias, if it has one."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[column], column)


def allowed_only(actions: Column, allowed: list[str]) -> Column:
    """The allowed ones of a list, in its order."""
    return F.filter(actions, lambda a: a.isin(*allowed))


def console(rows: DataFrame, search: str = "", columns: tuple[str, ...] = (), **equal: str) -> DataFrame:
    """Rows by chosen values ('all' does not narrow) and a text found in any of the columns."""
    for column, value in equal.items():
        if value != "all":
            rows = rows.where(F.col(column) == value)
    return rows.where(F.contains(lowered(F.concat_ws(" ", *columns)), F.lit(search.lower()))) if search else rows


def approvals(log: DataFrame, key: str, seq: str, status: str, approved: str = "approved") -> DataFrame:
    """Every approval of an append-only log with its outcome: the first of a request counts, later ones are refused."""
    own = Window.partitionBy(key).orderBy(seq)  # one request's approvals, a handful
    return log.where(F.col(status) == approved).withColumn("outcome", F.when(F.row_number().over(own) == 1, "approved").otherwise("already_approved"))


def vault_id(name: Column) -> Column:
    """A vault's id from its owner's name."""
    return F.concat(F.lit("vault_"), slug(name))


def inspected(files: DataFrame, kind: str = "kind", text: str = "text") -> DataFrame:
    """What a memory file holds: a preview of its text or drawing, its size, or an error for unknown kinds."""
    known = F.col(kind).isin("text", "image", "video")
    return files.withColumn("preview", F.when(F.col(kind) == "text", F.substring(text, 1, 100)).when(known, F.substring(text, 1, 200))).withColumn("size", F.length(text)).withColumn("error", F.when(~F.coalesce(known, F.lit(False)), "unknown type"))
