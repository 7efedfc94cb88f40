"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: marks stripped from both ends of a token.
EDGE = ".,!?;:()[]{}'\""


def lowered(x: Column) -> Column:
    """Lower case; null is empty."""
    return F.lower(F.coalesce(x, F.lit("")))


def any_of(text: Column, terms: list[str]) -> Column:
    """Whether the text holds any of the terms (substrings, as they stand)."""
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def n_of(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text holds."""
    return sum((text.contains(t).cast("int") for t in terms), F.lit(0))


def token_list(text: Column) -> Column:
    """Lower-cased tokens between white space without marks at their ends; empty ones go."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.btrim(w, F.lit(EDGE))))
    return F.filter(words, lambda w: w != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(token_list(text))


def masked(key: Column) -> Column:
    """A key as it may be shown: eight characters, dots, six; short keys are hidden whole."""
    return F.when(key.isNull(), None).when(F.length(key) <= 12, "hidden").otherwise(F.concat(F.left(key, F.lit(8)), F.lit("..."), F.right(key, F.lit(6))))


def last_four(key: Column) -> Column:
    return F.concat(F.lit("..."), F.right(key, F.lit(4)))


def fingerprint(key: Column) -> Column:
    """First twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 12)


def scope_key(client: Column, vault: Column, namespace: Column) -> Column:
    return F.concat_ws("::", client, vault, namespace)


def scope_parts(key: Column) -> Column:
    """client_id, vault_id and namespace of a scope key."""
    parts = F.split(key, "::", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("client_id"), F.get(parts, F.lit(1)).alias("vault_id"), F.get(parts, F.lit(2)).alias("namespace"))


def truncated(x: Column, n: int, default: str) -> Column:
    """Text of at most n characters; null becomes the default."""
    return F.substring(F.coalesce(x.cast("string"), F.lit(default)), 1, n)


def slug(x: Column, n: int = 24) -> Column:
    """Lower case, spaces and slashes as underscores, at most n characters."""
    return F.left(F.regexp_replace(F.lower(x), "[ /]", "_"), F.lit(n))


def json_string_size(text: Column) -> Column:
    """Characters of a text as an ASCII-only JSON string, quotes included."""
    plain = F.length(text) + 2
    two = F.regexp_count(text, F.lit(r'["\\\n\r\t\x08\x0C]'))
    six = F.regexp_count(text, F.lit(r"[\x00-\x07\x0B\x0E-\x1F\x7F-\x{FFFF}]"))
    twelve = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    # most texts hold none of these characters: one look at them instead of three
    return F.when(~text.rlike(r'["\\\x00-\x1F\x7F-\x{10FFFF}]'), plain).otherwise(plain + two + 5 * six + 11 * twelve)


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with computed columns behind a generator, so that an expression used several times, or in a filter, is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
