"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked, in turn, to the target shares of source, language and topic; then each document is sampled with
the probability that brings its cell of the three to its fitted weight. Only DataFrame functions: the table
of cells is made by one aggregation, each raking step is a window sum over one of the three columns of that small table, and a
document is kept when a uniform number made from the hash of its id falls under its cell's probability.

Targets are shares by value. Where none are given, a column's observed token shares are tempered: raised to a
power below 1 and scaled to sum to one, which lifts rare values and lowers common ones. Values without a target keep their observed share.

No document can be kept more than once, so a cell's weight is bound by tokens / budget while raking and what exceeds it goes to the other
cells of the same value. Where a value holds too few tokens for its share of the budget, the budget falls to the largest tried that meets the
targets: BUDGET is the most that is kept. `bounded=False` leaves the bound out and cuts probabilities at 1 instead, which
misses the targets of rare values; only the query op2_source_mixing asks for it, since its SQL twin is so defined.

Defined results: a null source, language or topic is a value of its own ('?'); null and empty texts hold 0 tokens,
weigh nothing and are never sampled; repeated rows get the same number and so the same fate, as does every null id; an
empty table gives no rows. Ties cannot arise: each document is decided on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, stored

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.7
ROUNDS = 12
#: Tokens to keep, as a share of all.
BUDGET = 0.6
#: Share by which the bound may miss a target more than raking without it does, and budgets tried (each 5 % less).
MISS, BUDGETS, FALL = 0.001, 12, 0.95
#: Topics by the first mark that a text holds, in this order, and the topic of texts without any.
TOPIC_MARKS = (("table", " | "), ("licence", "icense"), ("contact", "@"), ("code", "{"))
OTHER_TOPIC = "prose"


def topic_of(text: Column) -> Column:
    """A text's topic: the first of the marks it holds."""
    out = F
    for name, mark in TOPIC_MARKS:
        out = out.when(text.contains(mark), name)
    return out.otherwise(OTHER_TOPIC)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, the three columns and n_tokens of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"),
        topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
    )


def with_targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float) -> DataFrame:
    """Adds target_<dimension>, in tokens summing to the observed total, to each cell."""
    total = F.sum("tokens").over(Window.partitionBy())
    cells = cells.withColumn("total", total)
    for d in DIMENSIONS:
        own = F.sum("tokens").over(Window.partitionBy(d))
        share = own / F.col("total")
        if targets and d in targets:
            given = F.create_map(*[F.lit(x) for pair in targets[d].items() for x in pair])
            wanted = F.coalesce(given[F.col(d)], share)
        else:
            wanted = F.pow(share, temper)
        cells = cells.withColumn("own", own).withColumn("wanted", wanted)
        # each value counts once: its cells share its wanted weight by their tokens
        norm = F.sum(F.col("wanted") * F.col("tokens") / F.col("own")).over(Window.partitionBy())
        cells = cells.withColumn(f"target_{d}", F.col("wanted") / norm * F.col("total")).drop("own", "wanted")
    return cells


def rake(cells: DataFrame, rounds: int = ROUNDS, budget: float | None = None) -> DataFrame:
    """Adds `weight`: tokens of each cell after `rounds` rounds of fitting to the three targets, at most tokens / budget if one is given. Longer fits are written every ROUNDS rounds."""
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for done in range(rounds):
        if done and done % ROUNDS == 0:
            fitted = stored(fitted, "raked")
        for d in DIMENSIONS:
            fitted = fitted.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"target_{d}"), F.sum("weight").over(Window.partitionBy(d))), F.lit(0.0))) if budget is None else _bounded_step(fitted, d, budget)
    return fitted


def _bounded_step(fitted: DataFrame, d: str, budget: float) -> DataFrame:
    """One dimension's step: cells at their bound stay there and the others take what the target leaves; all shrink if the bounds alone exceed it."""
    most, value, target = F.col("tokens") / budget, Window.partitionBy(d), F.col(f"target_{d}")
    full = F.col("weight") >= most * (1 - 1e-12)
    sums = {"_held": F.when(full, most).otherwise(0.0), "_free": F.when(full, 0.0).otherwise(F.col("weight")), "_whole": F.col("weight")}
    fitted = fitted.withColumns({name: F.sum(c).over(value) for name, c in sums.items()})
    freely = F.least(most, F.coalesce(F.try_divide(F.col("weight") * (target - F.col("_held")), F.col("_free")), F.lit(0.0)))
    moved = F.when(target < F.col("_held"), F.col("weight") * F.try_divide(target, F.col("_whole"))).when(full, most).otherwise(freely)
    return fitted.withColumn("weight", moved).drop(*sums)


def _miss(fitted: DataFrame) -> float:
    """The largest distance of a value's fitted share from its target."""
    return fitted.agg(F.max(F.greatest(*[F.col(f"_miss_{d}") for d in DIMENSIONS]))).first()[0] or 0.0


def fit(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float, budget: float, rounds: int, bounded: bool = True) -> DataFrame:
    """The three columns of each cell of `cells` (tokens) and its documents' `prob`, written."""
    cells = stored(with_targets(cells, targets, temper), "targets")
    if cells.count() <= MAX_CELLS_SENT:  # a small table is fitted in one task instead of by a shuffle for each step
        cells = cells.coalesce(1)
    misses = {f"_miss_{d}": F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"target_{d}")) / F.col("total") for d in DIMENSIONS}
    fitted = rake(cells, rounds)
    if bounded:
        # a value cannot give more than all its tokens
        shares = [F.sum("tokens").over(Window.partitionBy(d)) / F.when(F.col(f"target_{d}") > 0, F.col(f"target_{d}")) for d in DIMENSIONS]
        least = cells.select(F.least(*shares).alias("share")).agg(F.min("share")).first()[0]
        budget = budget if least is None else min(budget, least)
        allowed = _miss(fitted.withColumns(misses)) + MISS
        tried = lambda at: stored(rake(cells, rounds, budget * FALL**at).withColumns(misses), "bounded")
        low, high, found = 0, BUDGETS - 1, {}
        while low < high:  # the first of the budgets that meets the targets, or else the last
            at = (low + high) // 2
            found[at] = tried(at)
            low, high = (low, at) if _miss(found[at]) <= allowed else (at + 1, high)
        if high not in found:
            found[high] = tried(high)
        fitted, budget = found[high], budget * FALL**high
    prob = F.round(F.least(F.lit(1.0), F.lit(budget) * F.col("weight") / F.col("tokens")), 9)
    return stored(fitted.select(*DIMENSIONS, prob.alias("prob")), "fitted")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id: the first 8 hex digits of its text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("?"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def calibrated(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, rounds: int = ROUNDS, bounded: bool = True) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, prob (rounded to 9 places) and sampled for every row of docs."""
    each = stored(described(docs), "described")
    cells = each.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    cells = stored(cells, "cells")
    # one row per observed combination of source, language and topic, all of them much fewer than documents
    out = each.join(fit(cells, targets, temper, budget, rounds, bounded), list(DIMENSIONS), "left")
    out = out.withColumn("prob", F.when(F.col("n_tokens") > 0, F.col("prob")).otherwise(0.0))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "prob", (uniform(F.col("doc_id")) < F.col("prob")).alias("sampled"))


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that calibrated() samples. The probability of a row's own cell is looked up beside its text, so texts are not shuffled while the cell table is small enough to send."""
    each = described(docs)
    cells = stored(each.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted = fit(cells, settings.get("targets"), settings.get("temper", TEMPER), settings.get("budget", BUDGET), settings.get("rounds", ROUNDS), settings.get("bounded", True))
    names = dict(zip([*DIMENSIONS, "prob"], free_names(docs, *[f"mix_{c}" for c in (*DIMENSIONS, "prob")]), strict=True))
    table = fitted.withColumnsRenamed(names)
    text = F.coalesce("text", F.lit(""))
    keyed = {"source": F.coalesce(F.col("source").cast("string"), F.lit("?")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("?")), "topic": topic_of(text)}
    n = table.count()
    rows = docs.withColumns({names[d]: c for d, c in keyed.items()})
    joined = rows.join(F.broadcast(table) if n <= MAX_CELLS_SENT else table, [names[d] for d in DIMENSIONS])
    has_word = F.col("text").rlike(WORD)
    return joined.where(has_word & (uniform(F.col("doc_id")) < F.col(names["prob"]))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Cells up to this many are sent to every executor (some 10 MB); more are joined by a shuffle.
MAX_CELLS_SENT = 100_000


def _oracle() -> str:
    """The same in DuckDB, each raking step a common table expression."""
    topic = " ".join(f"WHEN contains(t, '{mark}') THEN '{name}'" for name, mark in TOPIC_MARKS)
    steps = [
        "d AS (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, coalesce(text, '') AS t FROM documents)",
        f"e AS (SELECT doc_id, source, lang, CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic, "
        "len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM d)",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e WHERE n_tokens > 0 GROUP BY ALL)",
        "g0 AS (SELECT *, sum(tokens) OVER () AS total FROM c)",
    ]
    last = "g0"
    for d in DIMENSIONS:
        steps.append(f"o_{d} AS (SELECT *, sum(tokens) OVER (PARTITION BY {d}) AS own FROM {last})")
        steps.append(f"g_{d} AS (SELECT * EXCLUDE (own), pow(own / total, {TEMPER}) / sum(pow(own / total, {TEMPER}) * tokens / own) OVER () * total AS target_{d} FROM o_{d})")
        last = f"g_{d}"
    steps.append(f"w0 AS (SELECT *, tokens AS weight FROM {last})")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (weight), weight * target_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM w{n})")
            n += 1
    steps.append(f"p AS (SELECT source, lang, topic, round(least(1.0, {BUDGET} * weight / tokens), 9) AS prob FROM w{n})")
    steps.append("j AS (SELECT e.*, CASE WHEN n_tokens > 0 THEN prob ELSE 0.0 END AS pr FROM e LEFT JOIN p USING (source, lang, topic))")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, pr AS prob, "
        "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '?')), 1, 8) AS BIGINT) / 4294967296.0 < pr AS sampled FROM j"
    )


ORACLE = _oracle()
