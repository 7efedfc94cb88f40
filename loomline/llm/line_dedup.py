"""Line dedup over the whole corpus by an exact set-similarity join, with DataFrame functions only.

A line that is at least MIN_CHARS long and holds a word is the set of its words. It is removed if an earlier line (by document id,
hash of the text, line number) has a Jaccard similarity of THRESHOLD or more, be that earlier line removed or not. Lines are never shortened.

The join: words are hashed and ordered from rare to common by how often words of their hash bucket occur in all
texts (two ranks for each doubling); two similar sets share a word among the first n - ceil(THRESHOLD * n) + 1 of either (prefix filter). Pairs that
meet at a word must have close sizes (length filter), enough words left after their places (positional filter) and
word-parity bits that differ in no more places than the sets may (a lower bound of their difference); the Jaccard similarity of
those left is computed. Equal lines are counted once: first occurrences stand for all.

Where more than CROWD lines meet at a word, each is first held against LEADERS of them: the earliest line, the earliest that is
not near that one, and so on. Only lines that match none of their leaders at any word are then joined with all lines of the
crowd, so a group of many near copies costs rows in proportion to its lines. A word that so many lines may hold that one task
should not take them (its bucket's count is over PART_ROWS) is dealt over as many parts as its count asks for.

Defined results: null texts stay null, empty ones and short lines stay; rows that repeat an id and text are one document and don't remove each
other's lines; null ids come last; an empty table gives no rows. Words and lines are told apart by 57- and 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, SPACE, discard, free_names, stored

#: The least similarity, as a fraction of whole numbers.
MORE, OF = 4, 5
THRESHOLD = MORE / OF
MIN_CHARS = 20
#: Word buckets of the rarity table are 2 ** RANK_BITS: it is a constant inside the plan, so it has to stay small. Any table gives the same result.
RANK_BITS = 17
#: Lines of more words have a second set of parity bits, of half of their words: 64 bits would not tell them apart.
LONG_LINE = 64
CROWD, LEADERS = 512, 4
#: Lines of a word that one task may take.
PART_ROWS = 1 << 18
#: Where more lines are repeated than BROADCAST_ROWS, so many of the most repeated ones are left to their first occurrence by a broadcast, the others by a shuffle.
HOT_LINES = 20_000
#: Tables of keys up to this many rows are sent to every executor (some 50 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
NULL_ID = (1 << 63) - 1
ROW = ("line_key", "k", "n", "pos", "p1", "p2")


def _small(df: DataFrame) -> DataFrame:
    """df, to be sent to every executor if it is small enough (df is a stored table, so counting is cheap)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def lines_of(docs: DataFrame) -> DataFrame:
    """(k, h, line_no, line, line_key) of every line that takes part."""
    # in a select of its own, so that the hash of a text is not computed for each of its lines
    own = docs.select(_id_key().alias("k"), F.xxhash64("text").alias("h"), "text")
    rows = own.select("k", "h", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    long = (F.length("line") >= MIN_CHARS) & (F.ltrim("line", F.lit(BLANKS)) != "")
    return rows.where(long).withColumn("line_key", F.xxhash64("line"))


def plain_words(line: Column) -> Column:
    """The words of a line; empty ones may stand anywhere. Splitting at single spaces is cheaper than by an expression."""
    other = reduce(Column.__or__, [line.contains(c) for c in "\t\v\f\r"])
    return F.when(other, F.split(line, SPACE)).otherwise(F.split(line, " "))


def rank_of_count(count: int) -> int:
    """0..63, two for each doubling."""
    return min(63, int(2 * math.log2(max(1, count))))


def word_ranks(docs: DataFrame) -> Column:
    """A constant array of the rarity ranks of the hash buckets of words, from what stands between spaces and line breaks in all texts."""
    n = 1 << RANK_BITS
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    # four buckets a row: few groups stay in the fast part of the aggregation, and fewer rows are shuffled
    bucket = words.select(F.xxhash64("w").bitwiseAND(F.lit(n - 1)).cast("int").alias("b")).select(F.shiftright("b", 2).alias("row"), F.col("b").bitwiseAND(F.lit(3)).alias("i"))
    found = bucket.groupBy("row").agg(*[F.count(F.when(F.col("i") == i, F.lit(1))).alias(f"n{i}") for i in range(4)]).collect()  # at most 2 ** RANK_BITS / 4 rows
    ranks = ["0"] * n
    for r in found:
        for i in range(4):
            ranks[4 * r["row"] + i] = str(rank_of_count(r[f"n{i}"]))
    return F.expr(f"cast(split('{','.join(ranks)}', ',') as array<bigint>)")


def word_set(line: Column, ranks: Column) -> Column:
    """The line's distinct words as longs, rare ones first: rank in the upper bits, hash below."""

    def key(h: Column) -> Column:
        # never null, so that the array is sorted as plain longs
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(F.lit((1 << RANK_BITS) - 1))), F.lit(0).cast("long"))
        return F.shiftleft(rank, 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    hashes = F.transform(F.array_remove(plain_words(line), ""), lambda w: F.xxhash64(w))
    return F.sort_array(F.transform(F.array_distinct(hashes), key))


def _rank(word: Column) -> Column:
    return F.shiftrightunsigned(word, 57)


def is_hot(word: Column) -> Column:
    """Whether so many lines may hold the word that they are dealt over several parts."""
    return _rank(word) >= rank_of_count(PART_ROWS)


def parts_of(word: Column) -> Column:
    """The number of parts of a hot word: by the largest count of its rank."""
    return F.ceil(F.pow(F.lit(2.0), (_rank(word) + 1) / 2) / PART_ROWS).cast("int")


def _parity(words: Column) -> Column:
    """64 bits, of which each word flips one."""
    one = F.lit(1).cast("long")
    bits = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))))
    return F.coalesce(bits, F.lit(0).cast("long"))


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """df with computed columns behind a generator, so that what uses a column several times does not compute it again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def prefixes(lines: DataFrame, ranks: Column) -> DataFrame:
    """(meet, word, line_key, k, n, pos, p1, p2): a row for each prefix word of each line; meet names the word, or the line's part of it."""
    sets = _once(lines.select("line_key", "k", "line"), words=word_set(F.col("line"), ranks)).drop("line")
    n = F.size("words")
    half = F.when(n > LONG_LINE, _parity(F.filter("words", lambda w: F.shiftright(w, 12).bitwiseAND(F.lit(1)) == 1)))
    prefix = F.slice("words", F.lit(1), F.floor(n * (OF - MORE) / OF + 1e-9).cast("int") + 1)
    sets = sets.select("line_key", "k", n.alias("n"), _parity(F.col("words")).alias("p1"), F.coalesce(half, F.lit(0).cast("long")).alias("p2"), prefix.alias("prefix"))
    rows = sets.select("line_key", "k", "n", "p1", "p2", F.posexplode("prefix").alias("pos", "word"))
    word = F.col("word")
    meet = F.when(is_hot(word), _meet(word, F.pmod("line_key", parts_of(word)).cast("int"))).otherwise(word)
    return rows.select(F.coalesce(meet, F.lit(0).cast("long")).alias("meet"), "word", *ROW)


def may_match(a, b) -> Column:
    """Length, positional and parity filters of two prefix rows, given as functions from a column's name.

    In whole numbers: with Jaccard MORE / OF at least, MORE + OF times the shared words are at least MORE times both sizes, and
    MORE + OF times the words of only one side are at most OF - MORE times both sizes.
    """
    na, nb = a("n"), b("n")
    both, every = na + nb, MORE + OF
    close = (na * MORE <= nb * OF) & (nb * MORE <= na * OF) & ((na - a("pos")) * every >= both * MORE) & ((nb - b("pos")) * every >= both * MORE)
    whole, half = a("p1").bitwiseXOR(b("p1")), a("p2").bitwiseXOR(b("p2"))
    apart = F.when((na > LONG_LINE) & (nb > LONG_LINE), F.bit_count(whole.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(whole))
    return close & (apart * every <= both * (OF - MORE))


def _meet(word: Column, part: Column) -> Column:
    """The name of a part of a word; kept apart from the words themselves, which are not negative."""
    return F.xxhash64(word, part).bitwiseOR(F.lit(-(1 << 63)))


def _side(rows: DataFrame, s: str, *more: str) -> DataFrame:
    return rows.select(F.col("meet").alias(f"{s}_meet"), F.col("word").alias(f"{s}_word"), *[F.col(c).alias(f"{s}_{c}") for c in ROW], *more)


def _ab_may_match() -> Column:
    return may_match(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))


def is_early() -> Column:
    """Whether a row's place is among those where a set may first meet a set of its size or a larger one.

    They share MORE / (MORE + OF) of both sizes at least, so all but (OF - MORE) / (MORE + OF) of the smaller set's words, from the first shared one on.
    """
    return F.col("pos") * (MORE + OF) <= F.col("n") * (OF - MORE)


def met_rows(rows: DataFrame) -> DataFrame:
    """(meet, word, a_line_key, ..., crowd, b_line_key), in one pass over the prefix rows: pairs of small groups, and each row of a crowd once, without a partner.

    A pair is found from its larger set (a) at an early word of the smaller one (b), whichever of them comes first.
    """
    early = F.when(is_early(), F.lit(1))
    seen = rows.withColumn("size", F.count(early).over(Window.partitionBy("meet"))).withColumn("crowd", (F.col("size") > CROWD) | is_hot(F.col("word")))
    # both sides read one shuffle and stay sorted by meet; crowds have no rows on the right
    left = _side(seen.where(F.col("crowd") | (F.col("size") > F.coalesce(early, F.lit(0)))), "a", "crowd")
    right = _side(seen.where(is_early() & ~F.col("crowd")), "b")
    # ties go by k too: a side that does not read it would not share the other's shuffle
    tie = (F.col("a_k") > F.col("b_k")) | ((F.col("a_k") == F.col("b_k")) & (F.col("a_line_key") > F.col("b_line_key")))
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & tie)
    # a group that is no crowd is of one word
    joined = left.join(right, (F.col("a_meet") == F.col("b_meet")) & larger & _ab_may_match(), "left").where(F.col("crowd") | F.col("b_line_key").isNotNull())
    return joined.select("a_meet", "a_word", *[f"a_{c}" for c in ROW], "crowd", "b_line_key")


def _pair(a: Column, b: Column) -> list[Column]:
    """Two lines as columns a and b, the same whichever is named first."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def leader_pairs(crowds: DataFrame) -> DataFrame:
    """(a, b): the rows of crowds with those of their LEADERS that come first and may match."""
    over, out, free = Window.partitionBy("meet"), crowds, F.lit(True)
    leader = F.struct("k", *[c for c in ROW if c != "k"])
    for i in range(LEADERS):
        out = out.withColumn("free", free).withColumn(f"first{i}", F.min(F.when(F.col("free"), leader)).over(over))
        first = F.col(f"first{i}")
        near = (first["k"] <= F.col("k")) & (first["line_key"] != F.col("line_key")) & may_match(F.col, lambda c, first=first: first[c])
        out = out.withColumn(f"near{i}", F.coalesce(near, F.lit(False)))
        free = F.col("free") & ~F.col(f"near{i}") & (first["line_key"] != F.col("line_key"))
    tried = F.array_compact(F.array(*[F.when(F.col(f"near{i}"), F.col(f"first{i}.line_key")) for i in range(LEADERS)]))
    return out.select("line_key", F.explode(tried).alias("leader")).select(*_pair(F.col("line_key"), F.col("leader"))).distinct()


def crowd_pairs(asking: DataFrame, crowds: DataFrame) -> DataFrame:
    """(a, b): all pairs that may match of the asking rows with the rows of crowds; an asking row goes to all parts of its word."""
    word = F.col("word")
    meets = F.when(is_hot(word), F.transform(F.sequence(F.lit(0), parts_of(word) - 1), lambda i: _meet(word, i))).otherwise(F.array("meet"))
    left, right = _side(asking.withColumn("meet", F.explode(meets)), "a"), _side(crowds, "b")
    same_word = F.col("a_word").bitwiseXOR(F.col("b_word")) == 0  # not an equality, which Spark would shuffle by
    fits = (F.col("b_k") <= F.col("a_k")) & (F.col("a_line_key") != F.col("b_line_key")) & same_word & _ab_may_match()
    return left.join(right, (F.col("a_meet") == F.col("b_meet")) & fits).select(*_pair(F.col("a_line_key"), F.col("b_line_key"))).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, ranks: Column) -> DataFrame:
    """(a): the later lines of the pairs whose sets are similar. Only documents that hold a line of a pair are cut into lines again."""
    keys = pairs.select(F.col("a").alias("line_key")).union(pairs.select("b")).distinct()
    places = stored(keys.join(firsts, "line_key").select("line_key", "f"), "places")
    at = places.select("line_key", F.col("f.k").alias("k"), F.col("f.h").alias("h"), F.col("f.line_no").alias("line_no"))
    at, (k,) = _small(at), free_names(docs, "line_k")
    holders = docs.withColumn(k, _id_key()).join(_small(stored(at.select(F.col("k").alias(k)).distinct(), "holders")), k, "left_semi")
    texts = lines_of(holders).join(at, ["line_key", "k", "h", "line_no"]).dropDuplicates(["line_key"])
    sets = stored(texts.select("line_key", F.struct("k", "h", "line_no").alias("f"), word_set(F.col("line"), ranks).alias("words")), "sets")
    side = lambda c: sets.select(F.col("line_key").alias(c), F.col("f").alias(f"f{c}"), F.col("words").alias(f"w{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    later = F.when(F.col("fb") < F.col("fa"), F.col("a")).otherwise(F.col("b"))
    found = stored(both.where(common / (F.size("wa") + F.size("wb") - common) >= THRESHOLD).select(later.alias("a")).distinct(), "verified")
    discard(places), discard(sets)
    return found


def first_occurrences(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """The lines without the later occurrences of repeated ones. The most repeated ones go by a broadcast, so that none of them makes a large group."""
    repeated = stored(firsts.where("cnt > 1").select("line_key", F.col("f").alias("first_f"), "cnt"), "repeated")
    own = F.col("first_f").isNull() | (F.col("first_f") == F.struct("k", "h", "line_no"))
    if repeated.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(repeated.drop("cnt")), "line_key", "left").where(own).drop("first_f")
    most = stored(repeated.orderBy(F.desc("cnt"), "line_key").limit(HOT_LINES).drop("cnt"), "most")
    fewer = lines.join(F.broadcast(most), "line_key", "left").where(own).drop("first_f")
    return fewer.join(repeated.drop("cnt"), "line_key", "left").where(own).drop("first_f")


def matched_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a): the different lines that have a similar earlier one."""
    docs = docs.select("doc_id", "text")
    ranks = word_ranks(docs)
    met = stored(met_rows(prefixes(first_occurrences(lines, firsts), ranks)), "met")
    plain = met.where("b_line_key IS NOT NULL").select(*_pair(F.col("a_line_key"), F.col("b_line_key")))
    crowds = met.where("crowd").select(*[F.col(f"a_{c}").alias(c) for c in ("meet", "word", *ROW)])
    pairs = stored(plain.union(leader_pairs(crowds)).distinct(), "pairs")
    done = _verified(docs, pairs, firsts, ranks)
    asking = crowds.join(done.withColumnRenamed("a", "line_key"), "line_key", "left_anti")
    more = stored(crowd_pairs(asking, crowds).join(pairs, ["a", "b"], "left_anti"), "pairs")
    discard(met), discard(pairs)
    return done if more.isEmpty() else done.union(_verified(docs, more, firsts, ranks)).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(k, h, removed): sorted numbers of each document's removed lines, for documents that lose any."""
    lines = lines_of(docs)
    firsts = stored(lines.groupBy("line_key").agg(F.min(F.struct("k", "h", "line_no")).alias("f"), F.count(F.lit(1)).alias("cnt")), "firsts")
    matched = matched_lines(docs, lines, firsts).select(F.col("a").alias("line_key"), F.lit(True).alias("matched"))
    marked = firsts.join(matched, "line_key", "left").where((F.col("cnt") > 1) | F.col("matched"))
    marked = stored(marked.select("line_key", "f", F.coalesce("matched", F.lit(False)).alias("matched")), "marked")
    gone = lines.select("k", "h", "line_no", "line_key").join(_small(marked), "line_key").where(F.col("matched") | (F.col("f") != F.struct("k", "h", "line_no")))
    return gone.groupBy("k", "h").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """The text without the lines of the given sorted numbers, in one walk over its lines."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(removed, i - 1) + 1)
    stop = lambda lines, i: F.coalesce(F.get(removed, i), F.size(lines))
    runs = lambda lines: F.transform(F.sequence(F.lit(0), F.size(removed)), lambda i: F.slice(lines, start(i) + 1, stop(lines, i) - start(i)))
    # the lines are a lambda's argument, so that the text is not split again for each run
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.flatten(runs(lines)), "\n")), F.lit(0))


def dedup(docs: DataFrame, length: str | None = None, count: str | None = None) -> DataFrame:
    """docs with `text` without its removed lines; other columns and rows stay.

    length names a column that is to follow the length of texts that change; count a new one for the number of removed lines.
    """
    k, h, removed, kept = free_names(docs, "line_k", "line_h", "line_removed", "line_kept")
    gone = stored(removed_lines(docs).select(F.col("k").alias(k), F.col("h").alias(h), F.col("removed").alias(removed)), "removed")
    lost = gone.agg(F.sum(F.size(removed))).first()[0] or 0
    keyed = docs.withColumns({k: _id_key(), h: F.xxhash64("text")})
    joined = keyed.join(F.broadcast(gone) if lost <= BROADCAST_ROWS else gone, [k, h], "left")
    # under a name of its own: in a list of columns, a lambda that names `text` would take the new one
    made = joined.withColumn(kept, F.when(F.col(removed).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(removed))))
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.col(kept)}
    if length:
        columns[length] = F.when(F.col(removed).isNull(), F.col(length)).otherwise(F.length(kept).cast(docs.schema[length].dataType))
    if count:
        columns[count] = F.coalesce(F.size(removed), F.lit(0)).cast("long")
    return made.select(*[c.alias(name) for name, c in columns.items()])


def deduped(docs: DataFrame) -> DataFrame:
    """doc_id, text after removal and the number of removed lines of every row of docs."""
    return dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), count="n_removed")


#: The same in DuckDB: distinct lines, a plain prefix filter by exact rarity, Jaccard on lists.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
p AS (SELECT * FROM l WHERE length(line) >= 20 AND regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, row_number() OVER (ORDER BY min({'k': doc_id, 'i': line_no})) AS id, min({'k': doc_id, 'i': line_no}) AS f FROM p GROUP BY line),
s AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS ws FROM d),
t AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM s),
c AS (SELECT w, count(*) AS df FROM t GROUP BY w),
o AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS pos FROM t JOIN c USING (w)),
x AS (SELECT * FROM o WHERE pos <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.w = b.w AND b.id < a.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
m AS (SELECT DISTINCT a FROM (
  SELECT q.a, len(list_intersect(sa.ws, sb.ws)) AS i, len(sa.ws) AS na, len(sb.ws) AS nb FROM q JOIN s sa ON sa.id = q.a JOIN s sb ON sb.id = q.b)
  WHERE CAST(i AS DOUBLE) / (na + nb - i) >= 0.8),
r AS (SELECT p.doc_id, p.line_no FROM p JOIN d USING (line) LEFT JOIN m ON m.a = d.id WHERE m.a IS NOT NULL OR d.f <> {'k': p.doc_id, 'i': p.line_no}),
k AS (
  SELECT l.doc_id, string_agg(CASE WHEN r.doc_id IS NULL THEN line END, chr(10) ORDER BY l.line_no) AS text, count(r.doc_id) AS n_removed
  FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.line_no = l.line_no GROUP BY l.doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_removed, 0) AS n_removed
FROM documents LEFT JOIN k USING (doc_id)
"""
