"""Quality rules by compression bands.

A text is rejected when its zstandard ratio lies outside the band for its length, or when too much of it lies in
fixed-size chunks that do, the last and shorter one among them: repetitive and symbol-laden text compresses too well,
random text too badly. Simple counts of words, symbols, repeated lines and repeated three-word windows are given beside the verdict.

The bands were fitted once, on a bounded sample: the 1,652 documents of sf0.1 that are labelled quality 1, pass the base rule and
have an even crc32 of their id. Each holds the ratios of these documents of about its length and of random slices of them,
widened by about 0.03 (more where the sample has few). Rows labelled 0 took no part. Under about 128 bytes ratios tell little,
and hex digits are told from prose from some 3 KB up only. Texts in other scripts than the sample's need bands of their own.

Defined results: a null or empty text has no words, all counts are 0, and it is rejected (under 50 words).
Repeated rows are judged one by one; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import source_rows

#: Knots of the bands: (log2 of the bytes, least ratio, greatest ratio); straight lines between them, flat beyond.
BANDS = (
    (4, 0.5, 1.2), (5, 0.65, 1.3), (6, 0.75, 1.4), (7, 0.98, 1.55), (8, 1.22, 1.7), (9, 1.39, 1.79), (10, 1.65, 2.0), (11, 1.88, 2.13),
    (12, 2.02, 2.27), (13, 2.13, 2.38), (14, 2.2, 2.48), (15, 2.25, 2.6), (16, 2.3, 2.7), (17, 2.3, 2.9),
)
#: Bytes of a chunk, and the share of a text's bytes that may lie in chunks outside the band of their length.
CHUNK_BYTES, CHUNK_SHARE = 2048, 0.3
MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, whole_ratio double, bad_chunks long, n_chunks long"
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def in_band(ratio: float, size: int, bands=BANDS) -> bool:
    at = min(max(math.log2(size), bands[0][0]), bands[-1][0])
    (x, low, high), (x2, low2, high2) = next(pair for pair in zip(bands, bands[1:], strict=False) if at <= pair[1][0])
    part = (at - x) / (x2 - x)
    return low + part * (low2 - low) <= ratio <= high + part * (high2 - high)


def band_verdict(data: bytes, zstd: zstandard.ZstdCompressor, bands=BANDS) -> tuple[bool, float, int, int]:
    """(inside the bands, ratio of the whole, chunks outside, chunks)."""
    if not data:
        return False, 0.0, 0, 0
    ratio = len(data) / len(zstd.compress(data))
    chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)] if len(data) > CHUNK_BYTES else []
    bad = [len(c) for c in chunks if not in_band(len(c) / len(zstd.compress(c)), len(c), bands)]
    return in_band(ratio, len(data), bands) and sum(bad) <= CHUNK_SHARE * len(data), ratio, len(bad), len(chunks)


def judge(doc_id: int | None, text: str | None, zstd: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    spaces = sum(data.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    repeats = repeat_words(words)
    failed = n < MIN_WORDS or repeats > MAX_REPEAT_SHARE * n
    inside, ratio, bad, chunks = band_verdict(data, zstd)
    return doc_id, n, len(text) - spaces, symbols, dup_lines(data), repeats, failed, inside and not failed, ratio, bad, chunks


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=3)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = [judge(i, t.as_py(), zstd) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)


def quality(docs: DataFrame) -> DataFrame:
    """One row per document of docs (doc_id, text): counts, base rule and the verdict of the bands. No shuffle."""
    rows = source_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_judge_batches, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their own columns only; texts are judged beside their rows, without a join."""
    names = docs.columns
    ids = docs.schema

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=3)
        at = names.index("text")
        for batch in batches:
            kept = [judge(None, t.as_py(), zstd)[7] for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(passing, ids)
