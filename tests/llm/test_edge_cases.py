"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import corpus_pipeline
import pytest
from loomline.llm import html_extract, language_id, line_dedup, lm_scoring, mixing, packing, pii, quality, simhash, topk
from loomline.llm.queries import tokenizer_path
from pyspark.sql import functions as F

PROSE = " ".join(f"word{i * 7919 % 613} and then" for i in range(60))
TEXTS = [
    (1, PROSE, "en", "web"),
    (2, PROSE, "en", "web"),
    (2, PROSE, "en", "web"),
    (3, None, "en", "web"),
    (4, "", None, None),
    (5, " \n\t ", "de", "books"),
    (6, "12345 !!! \n\n mail bob.smith@example.org or +44 20 7946 0958", None, "web"),
    (7, " ".join(f"tok{i % 5003}" for i in range(60_000)), "de", None),
    (None, "a text without an id, but with a few words in it", "en", "web"),
    (None, None, None, None),
    (8, "a line that is said twice in here\na line that is said twice in here\nend", "fr", "web"),
    (9, "😀 naïve café   x", "fr", "books"),
]
CLASH = ["key", "word", "words", "line", "line_key", "n", "block", "fp", "part", "length", "topic", "prob", "k", "h", "f", "cnt", "c", "tokens", "weight", "component_id", "score", "removed", "a", "b"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*COLUMNS, *[F.lit("x").alias(c) for c in CLASH])


DOC_OPERATORS = {
    "language": lambda d: language_id.identify_held_out(d),
    "mixing": lambda d: mixing.calibrated(d),
    "pii": lambda d: pii.personal_data(d),
    "lm": lambda d: lm_scoring.score(d),
    "lines": lambda d: line_dedup.deduped(d),
    "quality": lambda d: quality.quality(d),
    "simhash": lambda d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_one_row_per_document(spark, name):
    got = DOC_OPERATORS[name](frame(spark, TEXTS))
    ids = sorted(str(r["doc_id"]) for r in got.select("doc_id").collect())
    assert ids == sorted(str(t[0]) for t in TEXTS)


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_empty_table(spark, name):
    assert DOC_OPERATORS[name](frame(spark, [])).count() == 0


def test_packing_covers_every_document(spark):
    got = packing.pack(frame(spark, TEXTS), tokenizer_path()).collect()
    assert {r["doc_id"] for r in got} == {t[0] for t in TEXTS}
    assert all(r["length"] == 1 for r in got if r["doc_id"] in (3, 4))
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = frame(spark, TEXTS).cache()
    got = stage(spark, docs, "")
    if at < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} <= {t[0] for t in TEXTS}
    assert stage(spark, frame(spark, []), "").count() == 0
    assert stage(spark, frame(spark, TEXTS).where("doc_id IS NULL"), "").columns == got.columns


def test_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, None, "<p>" + "long text, " * 40_000 + "</p>"), (3, "u", "no markup"), (4, "u", "<div " * 2000), (5, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 1] == ["", ""]
    assert [r["text"] for r in got if r["page_id"] == 3] == ["no markup"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (150, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0]), (200, []), (250, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    got = topk.top_k(df).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(0, 7), (0, 8)}
    assert topk.top_k(df.limit(0)).count() == 0


def test_defined_results(spark):
    docs = frame(spark, TEXTS)
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_held_out(docs).collect()}
    assert lang[3] == lang[4] == lang[5] == ("und", 0.0)
    marks = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert (marks[6]["n_email"], marks[6]["n_phone"], marks[3]["spans"]) == (1, 1, "")
    lm = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    assert lm[3]["n_tokens"] == lm[4]["n_tokens"] == lm[5]["n_tokens"] == 1
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[3]["fingerprint"] == "0" * 16 and prints[3]["component_id"] == prints[4]["component_id"] == prints[5]["component_id"] == 3
    mixed = {r["doc_id"]: r for r in mixing.calibrated(docs).collect()}
    assert (mixed[3]["n_tokens"], mixed[3]["prob"], mixed[3]["sampled"]) == (0, 0.0, False)
    lines = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.deduped(docs).collect()}
    assert lines[3] == (None, 0) and lines[4] == ("", 0) and lines[8] == ("a line that is said twice in here\nend", 1)
    good = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert good[3]["n_words"] == 0 and good[3]["base_failed"] and not good[3]["kept"]


def test_near_dedup_judges_rows_not_ids(spark):
    """Null ids and shared ids with other texts stay; copies go whatever their id; the smallest id stays."""
    other = [" ".join(f"t{k}x{i * 7919 % 613} so" for i in range(60)) for k in range(5)]
    rows = [(None, other[0]), (None, other[1]), (4, other[2]), (4, other[3]), (None, PROSE), (2, PROSE), (4, PROSE), (9, other[4]), (9, other[4]), (None, None), (None, "")]
    docs = frame(spark, [(i, t, "en", "web") for i, t in rows]).repartition(3)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect())
    assert kept == sorted([("None", other[0]), ("None", other[1]), ("4", other[2]), ("4", other[3]), ("2", PROSE), ("9", other[4]), ("None", "")])
