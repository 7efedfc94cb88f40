"""Best-fit-decreasing packing of token pieces into sequences.

Pieces are measured where their documents lie. What best-fit decreasing does to a piece depends on its length alone, so the
plan is made from the number of pieces of each length: at most `capacity` numbers, whatever the input. Lengths are
taken in falling order; a segment tree over remaining capacities finds the tightest open bin that takes
the length. Bins in the same state form ranges, so one step places many pieces, in the same bins one-by-one
placing would fill. The plan (ranges of ranks to ranges of bins) is broadcast and each piece finds its place by its rank
among the pieces of its length, counted per stored partition, so a very common length is spread over all of them.

Defined results: a null text is an empty document and gives one piece holding the end token; repeated rows are
packed each on its own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import source_rows, stored

CAPACITY = 1024
END_ID = 2
#: Words remembered by one Python worker before its table is emptied.
CACHE_WORDS = 400_000
_joined_space = re.compile(r" (?:\s|\Z)")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class TokenBytes:
    """Token ids of texts as little-endian 32-bit bytes, for a byte-level BPE file of the tokenizers library.

    The vocabulary's ids are its merge ranks, so a rank encoder built from the same file gives the same ids faster. A text in
    which no space is followed by more white space or by the end splits at its spaces without changing any token; its
    parts are then looked up in a table. Other texts, and those that hold an added token's content, go through the library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", ())}
        symbols = _byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.encoder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = tuple(special)
        self.words: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return np.array(self.encoder.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _joined_space.search(text) or any(content in text for content in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        words = self.words
        try:
            tail = b"".join([words[w] for w in rest])
        except KeyError:
            if len(words) > CACHE_WORDS:
                words.clear()
            for w in rest:
                if w not in words:
                    words[w] = self._bytes(" " + w)
            tail = b"".join([words[w] for w in rest])
        return self._bytes(first) + tail


_loaded: dict[str, TokenBytes] = {}


def token_bytes(path: str) -> TokenBytes:
    """One encoder for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = TokenBytes(path)
    return _loaded[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    head = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and the ids if asked for)."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * keep_ids

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(tokenizer_path)
        for b in it:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, k, start, n, zlib.crc32(own)) + ((np.frombuffer(own, "<u4").tolist(),) if keep_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return source_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(batches, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity that finds the smallest one with an open bin at or above a length."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)

    def set(self, at: int, some: bool) -> None:
        i = at + self.size
        self.any[i] = int(some)
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, pieces per bin, offset in bin) in length and rank order, and the number of bins."""
    tree, open_bins, plan, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, start: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((start, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            room = tree.tightest(length)
            if room is None:
                room, start = capacity, bins
                n = -(-(total - rank) // (capacity // length))
                bins += n
            else:
                start, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, (total - rank) // each)
            if full:  # bins that take as many as they can
                plan.append((length, rank, start, each, capacity - room))
                put(room - each * length, start, full)
                rank, start, n = rank + full * each, start + full, n - full
            if n and rank < total:  # one bin takes the few that are left
                plan.append((length, rank, start, each, capacity - room))
                put(room - (total - rank) * length, start, 1)
                rank, start, n = total, start + 1, n - 1
            put(room, start, n)
    return np.array(plan, np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """pieces() with each piece's sequence_id and offset."""
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer_path, capacity, end_id, keep_ids).withColumn("part", F.spark_partition_id()), "pieces")
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first_rank"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(best_fit_plan(totals, capacity))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids + ", sequence_id long, offset long"

    def place(own: pa.Table, starts: pa.Table) -> pa.Table:
        steps, _ = plan.value
        length = own.column("length").to_numpy()
        first = np.zeros(capacity + 1, np.int64)
        first[starts.column("length").to_numpy()] = starts.column("first_rank").to_numpy()
        by_length = np.argsort(length, kind="stable")
        kinds, at, sizes = np.unique(length[by_length], return_index=True, return_counts=True)
        rank = np.empty(len(length), np.int64)
        rank[by_length] = np.arange(len(length)) - np.repeat(at, sizes) + np.repeat(first[kinds], sizes)
        big = np.int64(1) << 50
        order = np.argsort((capacity - steps[:, 0]) * big + steps[:, 1], kind="stable")
        steps = steps[order]
        at = np.searchsorted((capacity - steps[:, 0]) * big + steps[:, 1], (capacity - length) * big + rank, "right") - 1
        k = rank - steps[at, 1]
        own = own.drop_columns("part")
        own = own.append_column("sequence_id", pa.array(steps[at, 2] + k // steps[at, 3]))
        return own.append_column("offset", pa.array(steps[at, 4] + k % steps[at, 3] * length))

    return made.groupBy("part").cogroup(ranks.groupBy("part")).applyInArrow(place, schema)
