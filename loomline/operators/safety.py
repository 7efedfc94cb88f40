"""Scans of texts and reports for terms, secrets and leaks, and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import lowered

#: Shapes of secrets.
SECRET_SHAPES = (r"AKIA[0-9A-Z]{16}", r"sk[-_][A-Za-z0-9_-]{16,}", r"ghp_[A-Za-z0-9]{20,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*\S{8,}")
EMAIL_SHAPE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms, in their order, that a text holds as substrings, case folded."""
    low = lowered(text)
    return F.filter(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms]), lambda t: t.isNotNull())


def missing_terms(text: Column, terms: list[str]) -> Column:
    low = lowered(text)
    return F.filter(F.array(*[F.when(~low.contains(t.lower()), F.lit(t)) for t in terms]), lambda t: t.isNotNull())


def secret_like(text: Column) -> Column:
    """Whether a text holds something shaped like a secret."""
    out = F.lit(False)
    for shape in SECRET_SHAPES:
        out = out | F.coalesce(text, F.lit("")).rlike(shape)
    return out


def scan(docs: DataFrame, key: str, text: str, forbidden: list[str]) -> DataFrame:
    """Per text: forbidden terms found, secret shapes, e-mail addresses, and whether it is clean. One pass, no shuffle."""
    found = terms_in(F.col(text), forbidden)
    emails = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(EMAIL_SHAPE))
    out = docs.select(key, F.array_join(found, ",").alias("terms"), secret_like(F.col(text)).alias("has_secret"), emails.cast("long").alias("n_emails"))
    return out.withColumn("clean", (F.col("terms") == "") & ~F.col("has_secret") & (F.col("n_emails") == 0))


def leaked_values(reports: DataFrame, key: str, text: str, secrets: DataFrame, secret: str) -> DataFrame:
    """(key, secret) wherever a report holds a known secret as a whole word; an equi-join on words, however many secrets there are."""
    words = reports.select(key, F.explode(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), r"[^A-Za-z0-9_#-]+"))).alias("_w"))
    known = secrets.select(secret).where(F.col(secret) != "").distinct()
    return words.join(known, words["_w"] == known[secret]).select(key, secret)


def public_report(path: Column) -> Column:
    """Whether a report's path may be shown: under reports/, of a known form, not of a private folder."""
    p = F.lower(path)
    return p.startswith("reports/") & ~p.contains("private") & ~p.contains("internal") & (p.endswith(".json") | p.endswith(".md"))


def version_of(path: Column) -> Column:
    """The number of the first version tag v### of a path; 9999 without one."""
    tag = F.regexp_extract(path, r"v([0-9]{3,4})", 1)
    return F.when(tag == "", 9999).otherwise(tag.cast("int"))
