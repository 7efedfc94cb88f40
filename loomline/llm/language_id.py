"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts come from labelled rows in a bounded, documented sample (max_train_docs, chosen by a hash
of the id, in equal parts per label); the log-probability matrix (buckets x languages, a fixed size per label) is broadcast
and whole texts are scored in numpy as sparse rows of bucket ids.

Defined results: null texts and texts without a letter get language `und` and score 0; with no labelled training row
every text is `und`. Repeated rows are scored alike, ties go to the label that sorts first, null ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, source_rows

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_TRAIN_DOCS = 20_000
#: Grams scored at once; bounds the memory of very long texts.
BLOCK = 1 << 18
_letter = re.compile(r"[^\W\d_]")
_mix = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _padded(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a space at either end."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Bucket of every 1-, 2- and 3-gram that ends at start .. stop - 1."""
    parts, before = [], min(start, len(ORDERS) - 1)
    points = points[start - before : stop]
    for k in range(len(ORDERS)):
        h = (h[: len(points) - k] * _mix[0] + points[k:] + np.uint32(k + 1)) if k else points * _mix[1] + np.uint32(1)  # noqa: F821
        x = h[max(0, before - k) :]
        x = (x ^ (x >> np.uint32(15))) * _mix[2]
        parts.append((x >> np.uint32(17)).astype(np.int32))
    return np.concatenate(parts)


def gram_ids(text: str) -> np.ndarray:
    """Bucket of every 1-, 2- and 3-gram of the lower-cased text with a space at either end."""
    points = _padded(text)
    return _grams(points, 0, len(points))


def gram_blocks(text: str) -> Iterator[np.ndarray]:
    """The same in blocks; grams that cross the border of two blocks come with the second."""
    points = _padded(text)
    for i in range(0, len(points), BLOCK):
        yield _grams(points, i, min(i + BLOCK, len(points)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = text.as_py() or ""
            total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for ids in gram_blocks(t):
                total += np.bincount(ids, minlength=BUCKETS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


def train(labelled: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(labels, float32 matrix BUCKETS x labels of log probabilities with a flat prior) from rows lang, text, doc_id.

    Each label gives about max_train_docs / labels rows at most; rows are chosen by the hash of their id.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    most = max(1, max_train_docs // len(langs))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, most / sizes[k]))])[F.col("lang")]
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    counted = chosen.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(langs)))
    np.add.at(counts, (counted["bucket"].to_numpy(np.int64), counted["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(np.int64)), counted["n"].to_numpy(np.float64))
    return langs, np.log((counts + alpha) / (counts + alpha).sum(0)).astype(np.float32)


def predict_text(text: str | None, langs: list[str], matrix: np.ndarray) -> tuple[str, float]:
    if not text or not langs or not _letter.search(text):
        return "und", 0.0
    total = np.zeros(len(langs))
    for ids in gram_blocks(text):
        # the same sum in double precision, by bucket where that is shorter
        total += np.bincount(ids, minlength=BUCKETS) @ matrix.astype(np.float64) if len(ids) > BUCKETS else matrix[ids].sum(0, dtype=np.float64)
    best = int(total.argmax())
    return langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, labelled: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, by a model fitted on labelled (doc_id, lang, text)."""
    spark = docs.sparkSession
    langs, matrix = train(source_rows(labelled, "doc_id", "lang", "text"), max_train_docs)
    model = spark.sparkContext.broadcast((langs, matrix))  # BUCKETS x labels floats, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = model.value
        for batch in batches:
            found = [predict_text(t.as_py(), names, logp) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return source_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(score, "doc_id long, lang_pred string, score double")


def identify_held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from rows whose id's crc32 mod folds is not 0; predict all rows and mark the held-out ones."""
    fold = F.coalesce(crc_mod("doc_id", folds), F.lit(0))
    rows = source_rows(docs, "doc_id", "lang", "text")
    labelled = rows.where(F.col("lang").isNotNull() & (fold != 0))
    return identify(rows, labelled).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")
