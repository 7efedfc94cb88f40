"""Retrieval baselines over topic memory: keyword hits, token overlap, newest, vivid and one-row answers, and full packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import n_of, once, token_set
from loomline.sources.shared import written

from .ranking import top_overall, top_per_group

#: Which answer field the value of a role fills.
FIELD_OF_ROLE = {"current_state": "current_state", "fake_current": "current_state", "near_miss": "current_state", "origin": "old_state", "risk_signal": "latent_risk", "human_context": "problem", "counter_evidence": "lineage_reason"}
FIELDS = ("current_state", "old_state", "problem", "latent_risk", "lineage_reason")


def row_text(columns: list[str]) -> Column:
    """A row as searchable text: sorted names and values in JSON spelling, names included."""
    parts = []
    for c in sorted(columns):
        value = F.coalesce(F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{c}": '), value))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def keyword_hits(df: DataFrame, text: Column, terms: list[str], k: int, order: list[str]) -> DataFrame:
    """The k rows of all that hold most of the terms (newest first among equals); rows without a term are out."""
    rows = once(once(df, _text=F.lower(text)), hits=n_of(F.col("_text"), terms)).drop("_text").where("hits > 0")
    return top_overall(rows, [F.desc("hits"), *[F.desc(c) for c in order]], k)


def overlap(tokens: Column, query: Column) -> Column:
    """Share of the query's tokens that are among the tokens."""
    return F.size(F.array_intersect(query, tokens)) / F.greatest(F.size(query), F.lit(1))


def overlap_per_topic(df: DataFrame, keys: list[str], text: Column, query: Column, k: int, order: list[str]) -> DataFrame:
    """The k rows of each topic whose tokens overlap most with the query, newest first among equals."""
    rows = df.withColumn("overlap", overlap(token_set(text), token_set(query)))
    return top_per_group(rows, keys, [F.desc("overlap"), *[F.desc(c) for c in order]], k)


def one_row_answer(rows: DataFrame, keys: list[str], role: str = "signal_type", value: str = "memory_value") -> DataFrame:
    """Answers made of one row each: its value in the field of its role, nulls elsewhere."""
    field = F.create_map(*[F.lit(x) for pair in FIELD_OF_ROLE.items() for x in pair])[F.col(role)]
    return rows.select(*keys, *[F.when(field == f, F.col(value)).alias(f) for f in FIELDS])


def newest_preferred(df: DataFrame, keys: list[str], preferred: Column, order: list[str], columns: list[str]) -> DataFrame:
    """Newest row among the preferred ones of a topic, or of all if there is none."""
    best = F.max_by(F.struct(*columns), F.struct(F.coalesce(preferred, F.lit(False)), *order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in columns])


def fill_from_fragments(rows: DataFrame, keys: list[str], order: list[str], role: str = "signal_type", value: str = "memory_value") -> DataFrame:
    """Answers filled from retrieved rows in order, later ones over earlier ones."""
    field = F.create_map(*[F.lit(x) for pair in FIELD_OF_ROLE.items() for x in pair])[F.col(role)]
    at = F.struct(*order)
    return rows.withColumn("_f", field).groupBy(*keys).agg(*[F.max_by(value, F.when(F.col("_f") == f, at)).alias(f) for f in FIELDS])


def terms_found(docs: DataFrame, key: str, text: Column, terms: DataFrame, term: str) -> DataFrame:
    """(key, term) for every term of a term table that a text holds as whole tokens; matched by join, not by pairs."""
    tokens = docs.select(key, F.explode(token_set(text)).alias("_token"))
    wanted = terms.select(term).distinct()
    return tokens.join(wanted, tokens["_token"] == wanted[term]).select(key, term)


def _wanted_sets(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(_set): the different sets of tokens of texts, as far as they are in the vocabulary (_token); no empty ones."""
    held = texts.select(text).distinct().select(text, F.explode(token_set(F.col(text))).alias("_token"))
    return held.join(vocabulary, "_token", "left_semi").groupBy(text).agg(F.sort_array(F.collect_list("_token")).alias("_set")).select("_set").distinct()


def best_overlaps(rows: DataFrame, text: Column, terms: DataFrame, term: str, least: float = 0.5) -> DataFrame:
    """Each term's best token overlap with any one row, and whether it reaches `least`; token sets of terms meet only those of rows that share a token.

    terms has one column of texts (repeats count once). Overlap is the share of the term's distinct tokens that the row holds; a term without tokens has 0.
    Of the rows, only the different sets of those tokens that some term has are joined, so repeats of a text and tokens of no term cost no pairs.
    """
    wanted = written(terms.select(term).distinct().withColumn("_tokens", F.sort_array(token_set(F.col(term)))), "terms")
    asked = wanted.select(F.col("_tokens").alias("_asked")).distinct().select("_asked", F.explode("_asked").alias("_token"))
    sets = written(_wanted_sets(rows.select(text.alias("_text")), "_text", asked.select("_token").distinct()), "sets")
    held = sets.select(F.col("_set"), F.explode("_set").alias("_token"))
    met = held.join(asked, "_token").groupBy("_asked", "_set").agg(F.count(F.lit(1)).alias("_n"))
    best = met.groupBy("_asked").agg((F.max("_n") / F.size("_asked")).alias("overlap"))
    out = wanted.join(best.withColumnRenamed("_asked", "_tokens"), "_tokens", "left").select(term, F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    return out.withColumn("hit", F.col("overlap") >= least)


#: Estimates of the static baselines; None is the share of keywords that are found.
BASELINES = {"raw_storage": (1.0, 0.6, 0.4), "basic_summary": (0.55, 0.45, 0.55), "keyword_search": (None, 0.65, 0.55)}


def static_baselines(rows: DataFrame, keys: list[str], text: Column, order: list[str], keywords: list[str], first: int = 5) -> DataFrame:
    """keys, method, storage_bytes, accuracy, continuity, noise_resistance: all texts, the first few, and keywords looked for in all."""
    rows = once(rows, _text=F.coalesce(text, F.lit("")))
    size = F.octet_length("_text")
    found = [F.bool_or(F.contains(F.lower("_text"), F.lit(k.lower()))).cast("int") for k in keywords]
    hits = sum(found[1:], found[0]) if found else F.lit(0)
    whole = rows.groupBy(*keys).agg(F.sum(size).alias("_bytes"), (hits / max(len(keywords), 1)).alias("_share"))
    head = top_per_group(rows, keys, [F.asc(c) for c in order], first).groupBy(*keys).agg((F.sum(size) + F.count(F.lit(1)) - 1).alias("_head"))
    both = whole.join(head, keys)
    told = []
    for method, (accuracy, continuity, noise) in BASELINES.items():
        own = F.col("_share") if accuracy is None else F.lit(accuracy)
        told.append(F.struct(F.lit(method).alias("method"), F.col("_head" if method == "basic_summary" else "_bytes").alias("storage_bytes"), own.cast("double").alias("accuracy"), (F.least(own, F.lit(continuity)) if accuracy is None else F.lit(continuity)).alias("continuity"), F.lit(noise).alias("noise_resistance")))
    return both.select(*keys, F.inline(F.array(*told)))
