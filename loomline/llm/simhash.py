"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect binary Golay code (23, 12)
maps every 23-bit word to the one codeword within three bits. Decoding a segment gives one index key;
decoding it and all words one bit away gives at most six keys, among them the index key of every word one bit off.
Two fingerprints that differ in at most two bits agree exactly on some segment and differ in at most one bit on the
segment after it (cyclically), so joining (exact segment, index key) with (exact segment, any of the keys) for
the three choices finds every pair, which a bit count then verifies.

Keys at which many fingerprints meet would make many pairs. There, every fingerprint instead names itself
and its 64 one-bit neighbours; two fingerprints are within two bits exactly if they share such a point, and linking each
to the smallest at the point gives the same components with rows in proportion to the fingerprints.

Defined results: null, empty and white-space texts have fingerprint zero and link to each other; repeated
rows get the same row again; null ids never become a component's id while another id is there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, source_rows, stored
from .components import components

SEED = 42
MAX_BITS = 2
#: Largest product of index and probing rows at one key that is joined pair by pair.
MAX_KEY_PAIRS = 1024
#: Dropped ids up to this many are sent to every executor (16 MB of ids); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Near-duplicates of a stage: words of a shingle, and the least Jaccard similarity as a fraction of whole numbers.
WIDTH, MORE, OF = 5, 4, 5
#: Shingles are counted in 2 ** COUNT_BITS hash buckets, whose ranks (1 MB) every task gets; sketches of shingle sets have so many bits.
COUNT_BITS, SKETCH_BITS = 20, 1024
MIX = np.uint64(0x9E3779B97F4A7C15)
ROW_KEY = ("no_id", "id", "text_hash")
#: Fixed value: generator polynomial of the binary Golay code (23, 12).
GOLAY = 0b110001110101
#: (shift, bits) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def _remainders() -> np.ndarray:
    """Remainder of m * x^11 by the generator for each 12-bit m."""
    out = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GOLAY << (bit - 11)
        out[m] = r
    return out


def _corrections(rem: np.ndarray) -> np.ndarray:
    """For each 11-bit syndrome the error word of three bits at most."""
    one = np.array([1 << i for i in range(23)], np.int64)
    out = np.zeros(2048, np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                e = one[i] | one[j] | one[k]
                out[rem[e >> 11] ^ (e & 2047)] = e
    out[0] = 0
    return out


class Golay:
    """Decoder from 23-bit words to 12-bit codeword indices, on numpy arrays."""

    def __init__(self) -> None:
        self.rem = _remainders()
        self.fix = _corrections(self.rem)

    def decode(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.fix[self.rem[words >> 11] ^ (words & 2047)]) >> 11

    def nearby(self, words: np.ndarray) -> np.ndarray:
        """Indices of each word and its 23 neighbours, one row per word."""
        flips = np.concatenate([[0], 1 << np.arange(23)])
        return self.decode(words[:, None] ^ flips[None, :])


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The 64 bits that are set in over half of n hashes, which come in parts."""
    ones = np.zeros(64, np.int64)
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    n = len(shingles)
    parts = (shingles[at : at + (1 << 16)] for at in range(0, n, 1 << 16))
    return majority((np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part)) for part in parts), n)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash) per row; fp is the fingerprint's 64 bits as a signed long, text_hash tells rows that share an id apart."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "text_hash"])

    rows = source_rows(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(batches, "doc_id long, fp long, text_hash long")


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, is_index): for each choice of exact segment one index key and the probing keys."""
    golay = Golay()
    for batch in it:
        fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        for at in range(0, len(fp), 1 << 14):
            part = fp[at : at + (1 << 14)]
            seg = [((part >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
            keys, rows, index = [], [], []
            for i in range(3):
                near = seg[(i + 1) % 3]
                head = (np.int64(i) << 35) | (seg[i] << 12)
                keys.append(head | golay.decode(near))
                rows.append(part)
                index.append(np.ones(len(part), bool))
                some = np.sort(golay.nearby(near), axis=1)
                first = np.ones(some.shape, bool)
                first[:, 1:] = some[:, 1:] != some[:, :-1]
                r, c = np.nonzero(first)
                keys.append(head[r] | some[r, c])
                rows.append(part[r])
                index.append(np.zeros(len(r), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rows).view(np.int64)), pa.array(np.concatenate(index))], ["key", "fp", "is_index"])


def links(distinct_fp: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all fingerprints (column fp, distinct) within two bits."""
    keys = stored(distinct_fp.mapInArrow(_keys, "key long, fp long, is_index boolean"), "keys")
    sizes = keys.groupBy("key").agg(F.count_if("is_index").alias("n_index"), F.count_if(~F.col("is_index")).alias("n_probe"))
    met = stored(sizes.where("n_index > 0 and n_index + n_probe > 2").select("key", (F.col("n_index") * F.col("n_probe") > MAX_KEY_PAIRS).alias("crowded")), "met")
    live = keys.join(met, "key")
    few = live.where(~F.col("crowded"))
    a, b = few.where("is_index").select("key", F.col("fp").alias("u")), few.where(~F.col("is_index")).select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    crowded = live.where("crowded").select("fp").distinct()
    points = crowded.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "v")
    stars = points.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of docs (doc_id, text)."""
    each = stored(fingerprints(docs, width), "fingerprints")
    own = each.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    label = stored(components(links(own.select("fp"))), "components").select(F.col("node").alias("fp"), "component")
    linked = own.join(label, "fp")
    whole = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    moved = linked.join(whole, "component").select("fp", "component_id")
    # written first, so that nothing but the join below is done where many documents share a fingerprint and it can be split
    ids = stored(own.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "ids")
    out = each.join(ids, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def shingle_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each WIDTH-word shingle, repeats included (fewer words: of the whole sequence; none: no hash)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ word[j : j + len(out)]) * MIX
        out ^= out >> np.uint64(31)
    return out


def _set_key(members: np.ndarray) -> int:
    """The name of a set of shingles: 64 bits over its sorted members."""
    return xxhash.xxh64_intdigest(members.tobytes(), SEED)


def _sketch(members: np.ndarray) -> bytes:
    """SKETCH_BITS parity bits, of which each member flips one; the bits that two sketches differ in are a lower bound of what the sets differ in."""
    flips = np.bincount((members >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(no_id, id, text_hash, cls, fp, n, sketch) per row: cls names its set of shingles, fp is the SimHash over them, n their number."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cls, fp, n, sketch = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), [], []
            for i, text in enumerate(b.column("text")):
                hashes = shingle_hashes(text.as_py())
                members = np.unique(hashes)
                cls[i], fp[i] = _set_key(members), majority((hashes[at : at + (1 << 16)] for at in range(0, len(hashes), 1 << 16)), len(hashes))
                n.append(len(members))
                sketch.append(_sketch(members))
            made = [_signed(cls), _signed(fp), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ROW_KEY], *made], [*ROW_KEY, "cls", "fp", "n", "sketch"])

    rows = source_rows(docs, "doc_id", "text").select(*row_key(), "text")
    return rows.mapInArrow(batches, "no_id boolean, id long, text_hash long, cls long, fp long, n long, sketch binary")


def row_key() -> list[Column]:
    """A row is known by its id and its text."""
    own = F.col("doc_id").cast("long")
    return [own.isNull().alias("no_id"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash")]


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def shingle_ranks(texts: DataFrame) -> np.ndarray:
    """A rank for each hash bucket of shingles, two for each doubling of the times that all texts hold one; any ranks give the same links."""

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in it:
            for text in b.column(0):
                np.add.at(total, (shingle_hashes(text.as_py()) & np.uint64(len(total) - 1)).astype(np.int64), 1)
        found = np.nonzero(total)[0]
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** COUNT_BITS rows
    ranks = np.zeros(1 << COUNT_BITS, np.uint8)
    ranks[sums["bucket"].to_numpy()] = np.minimum(255, 2 * np.log2(sums["n"].to_numpy())).astype(np.uint8)
    return ranks


def prefix_rows(texts: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(h, cls, n, pos): the first n - ceil(MORE / OF * n) + 1 shingles of each text, rare ones first. Similar texts share one of them."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for text in b.column(0):
                members = np.unique(shingle_hashes(text.as_py()))
                n = len(members)
                if n:
                    m = n * (OF - MORE) // OF + 1
                    first = members[np.lexsort((members, ranks[(members & np.uint64(len(ranks) - 1)).astype(np.int64)]))[:m]]
                    key = np.full(m, _set_key(members), np.uint64)
                    yield pa.RecordBatch.from_arrays([_signed(first), _signed(key), pa.array(np.full(m, n)), pa.array(np.arange(m))], ["h", "cls", "n", "pos"])

    return texts.select("text").mapInArrow(batches, "h long, cls long, n long, pos long")


def similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a Jaccard similarity of MORE / OF or more: first by size and sketch, then exactly."""

    def close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb")]
            apart = np.bitwise_count(both[0] ^ both[1]).sum(1, dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            sizes = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            yield batch.select(["a", "b"]).filter(pa.array((MORE + OF) * apart <= (OF - MORE) * sizes))

    sides = [classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").where((F.col("na") * MORE <= F.col("nb") * OF) & (F.col("nb") * MORE <= F.col("na") * OF))
    left = stored(met.mapInArrow(close, "a long, b long"), "near-pairs")
    asked = left.select(F.col("a").alias("cls")).union(left.select("b")).distinct()
    holders = stored(asked.join(classes, "cls").select("row.*"), "near-rows")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for text in b.column(0):
                members = np.unique(shingle_hashes(text.as_py()))
                yield pa.RecordBatch.from_arrays([_signed(np.array([_set_key(members)], np.uint64)), pa.array([members.view(np.int64)], pa.list_(pa.int64()))], ["cls", "members"])

    texts = docs.select(*row_key(), "text").join(_sent(holders), list(ROW_KEY), "left_semi").select("text")
    known = stored(texts.mapInArrow(sets, "cls long, members array<long>").dropDuplicates(["cls"]), "near-sets")
    both = left.join(known.select(F.col("cls").alias("a"), F.col("members").alias("ma")), "a").join(known.select(F.col("cls").alias("b"), F.col("members").alias("mb")), "b")
    common = F.size(F.array_intersect("ma", "mb"))
    found = stored(both.where(common * OF >= (F.size("ma") + F.size("mb") - common) * MORE).select("a", "b"), "near-links")
    discard(left), discard(holders), discard(known)
    return found


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose classes are not yet of one component."""
    a, b = [label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    known = pairs.join(a, "a", "left").join(b, "b", "left")
    return known.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_classes(docs: DataFrame, each: DataFrame) -> DataFrame:
    """(cls, component) of the classes that are near another one, from the rows of shingle_sets.

    First come the links of the fingerprints, found by Golay keys and verified. Then, as a Jaccard similarity of 0.8 leaves some ten bits of
    a fingerprint different, prefix shingles find all others: every class at a shingle is held against the first one there; where more
    than one component is still left at a shingle, all classes outside its largest component are held against the other components' classes.
    That last join makes all pairs within a group whose shingles are led by a class from outside it.
    """
    row = F.struct(*ROW_KEY)
    classes = stored(each.groupBy("cls").agg(F.min(row).alias("row"), F.any_value("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "classes")
    copies = each.select("cls", row.alias("own")).join(classes.select("cls", "row"), "cls").where("own <> row").select("own.*").distinct()
    texts = docs.select(*row_key(), "text").join(_sent(stored(copies, "copies")), list(ROW_KEY), "left_anti").select("text")

    own = stored(classes.groupBy("fp").agg(F.min("cls").alias("cls"), F.max("cls").alias("last")), "prints")
    u, v = [own.select(F.col("fp").alias(f), F.col("cls").alias(c)) for f, c in (("u", "a"), ("v", "b"))]
    golay = links(own.select("fp")).join(u, "u").join(v, "v").select("a", "b")
    same = classes.select(F.col("cls").alias("a"), "fp").join(own.where("cls <> last").select("fp", F.col("cls").alias("b")), "fp").where("a <> b").select("a", "b")
    edges = similar(docs, classes, golay.union(same).distinct())
    label = stored(components(edges.toDF("u", "v")), "components")

    rows = stored(prefix_rows(texts, shingle_ranks(texts)), "prefixes")
    met = rows.groupBy("h").agg(F.min("cls").alias("lead"), F.max("cls").alias("last")).where("lead <> last").drop("last")
    shared = stored(rows.join(met, "h"), "shared")
    discard(rows)
    first = shared.where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b")).distinct()
    edges = edges.union(similar(docs, classes, _across(first, label)))
    label = stored(components(edges.toDF("u", "v")), "components")

    named = stored(shared.distinct().join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "named")
    sizes = named.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("h").agg(F.max_by("component", "n").alias("main"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where("k > 1 and n > 2").select("h", "main")
    live = stored(named.join(main, "h").where("cls <> lead").drop("lead"), "live")
    l, r = [live.select("h", "main", *[F.col(c).alias(f"{s}_{c}") for c in ("cls", "n", "pos", "component")]) for s in "ab"]
    apart = (F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("main")) | (F.col("a_cls") < F.col("b_cls")))
    need = (F.col("a_n") + F.col("b_n")) * MORE
    fits = ((F.col("a_n") - F.col("a_pos")) * (MORE + OF) >= need) & ((F.col("b_n") - F.col("b_pos")) * (MORE + OF) >= need)
    pairs = l.where("a_component <> main").join(r.drop("main"), "h").where(apart & fits).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()
    more = similar(docs, classes, pairs)
    if not more.isEmpty():
        label = stored(components(edges.union(more).toDF("u", "v")), "components")
    discard(shared), discard(named), discard(live)
    return label.withColumnRenamed("node", "cls")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one row of each group of near-duplicates: the one with the smallest id (null ids last), then text hash.

    Texts are linked whose sets of WIDTH-word shingles have a Jaccard similarity of MORE / OF or more; groups are the components. Null
    texts and those without a word are one group. A row is known by its id and text, so rows that only share an id, or have
    none, are judged each on their own. Rows that repeat both are one document; of them the one stays whose columns are smallest.
    """
    each = stored(shingle_sets(docs), "shingled")
    label = near_classes(docs, each)
    found = stored(each.join(label, "cls", "left").select(F.coalesce("component", "cls").alias("component"), F.struct(*ROW_KEY).alias("row")), "groups")
    firsts = found.groupBy("component").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last").select("component", "first")
    gone = stored(found.join(firsts, "component").where("row <> first").select("row.*").distinct(), "gone")
    again = stored(found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row.*").join(gone, ["no_id", "id", "text_hash"], "left_anti"), "again")
    names = {"no_id": "_near_no_id", "id": "_near_id", "text_hash": "_near_text"}
    own = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"_near_no_id": own.isNull(), "_near_id": F.coalesce(own, F.lit(0)), "_near_text": F.xxhash64("text")})

    def sent(rows: DataFrame) -> DataFrame:
        n, rows = rows.count(), rows.withColumnsRenamed(names)
        return F.broadcast(rows) if n <= BROADCAST_ROWS else rows

    keys, columns = list(names.values()), [F.col(f"`{c}`") for c in docs.columns]
    kept = keyed.join(sent(gone), keys, "left_anti")
    if again.isEmpty():
        return kept.select(columns)
    once = kept.join(sent(again), keys, "left_anti").select(columns)
    repeated = kept.join(sent(again), keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_near_row"))
    return once.union(repeated.select("_near_row.*"))
