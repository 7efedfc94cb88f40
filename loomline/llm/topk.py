"""Exact top-k search by multi-resolution segment statistics.

Every vector is cut into 1, 2, 4, ... equal segments; of each segment the mean and deviation are kept. By the
Cauchy-Schwarz inequality the inner product of two segments of m components is at most
m * (mean_a * mean_b + dev_a * dev_b), so the statistics bound every score from above - equivalently, with the norms known,
the distance from below. Bounds are taken coarse to fine: candidates under the k-th best score known are left out after each level,
and exact integer products of the survivors decide.

Queries and candidates are dealt in blocks and every (query block, candidate block) is one group, so the work is
spread evenly whatever the number of queries; a query keeps k rows per candidate block, and a last ranking takes its best.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; only vectors of
the query's own dimension are its candidates; ties go to the smaller vec_id; a repeated id is a candidate per row,
but a query never meets its own id; query rows that repeat id and vector are one query, other vectors of one id are queries of their own; a query without candidates gives no row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 5
QUERY_EVERY = 50
#: Rows of a block of candidates and of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
#: Scores whose size stays below this are exact in double precision.
EXACT = float(1 << 53)


def scaled(column: str = "embedding"):
    """floor(256 * x) of each component as long."""
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(column: str = "embedding"):
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))


def segment_stats(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations (rows x parts), weighted by sqrt(segment length) so that their products sum to a bound."""
    cuts = np.linspace(0, x.shape[1], parts + 1).astype(int)
    means, devs = np.empty((len(x), parts)), np.empty((len(x), parts))
    for i in range(parts):
        seg = x[:, cuts[i] : cuts[i + 1]]
        m = np.sqrt(seg.shape[1])
        means[:, i], devs[:, i] = seg.mean(1) * m, seg.std(1) * m
    return means, devs, cuts


def _resolutions(dim: int) -> list[int]:
    out, n = [], 1
    while n <= min(16, dim):
        out.append(n)
        n *= 4
    return out


def block_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of each query within one pair of blocks; survivors of the bounds are scored exactly."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    dim = q.shape[1]
    big = max(np.abs(q).max(initial=0).item(), 1) * max(np.abs(c).max(initial=0).item(), 1) * dim
    exact = np.float64 if big < EXACT else object if big >= 1 << 62 else np.int64
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qx, cx = q.astype(exact), c.astype(exact)
    levels = [tuple(np.concatenate(segment_stats(x, p)[:2], 1) for x in (qf, cf)) for p in _resolutions(dim)]
    slack = 1e-9 * (np.linalg.norm(qf, axis=1) * np.linalg.norm(cf, axis=1).max(initial=0)) + 1e-6
    out = []
    for at in range(0, len(q), 128):
        coarse = levels[0][0][at : at + 128] @ levels[0][1].T
        for i in range(at, at + len(coarse)):
            row = coarse[i - at] + slack[i]
            row[cid == qid[i]] = -np.inf
            live = np.flatnonzero(row > -np.inf)
            if not len(live):
                continue
            least = -np.inf
            if len(live) > k:  # exact scores of a few that look best give the k-th best so far
                few = np.argpartition(-row, min(4 * k, len(live)) - 1)[: 4 * k]
                few = few[row[few] > -np.inf]
                least = np.sort(cx[few] @ qx[i])[-k]
                live = live[row[live] >= least]
            for qs, cs in levels[1:]:  # finer bounds of those that are left
                live = live[cs[live] @ qs[i] + slack[i] >= least]
            scores = cx[live] @ qx[i]
            best = np.lexsort((cid[live], -scores))[:k]
            out += [(int(qid[i]), int(cid[live[b]]), int(scores[b])) for b in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row whose vec_id is divisible by query_every."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(usable() & F.col("vec_id").isNotNull())
    rows = stored(rows.select("vec_id", scaled().alias("v")).withColumn("dim", F.size("v")), "vectors")
    n = rows.count()
    n_cand, n_query = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n // (query_every * QUERY_BLOCK)))
    queries = rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "v"])
    blocks = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    c = rows.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_cand)).cast("int").alias("cb"), blocks(n_query, "qb"))
    q = queries.select("vec_id", "v", "dim", F.pmod(F.xxhash64("v", "vec_id"), F.lit(n_query)).cast("int").alias("qb"), blocks(n_cand, "cb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "vector": []}).astype("int64")]
        if len(left) and len(right):
            ids, candidates = right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy())
            for _, own in left.groupby(left.groupby("vec_id").cumcount()):  # vectors that share an id are queries of their own
                best = block_top(own["vec_id"].to_numpy(), np.stack(own["v"].to_numpy()), ids, candidates, k)
                best["vector"] = best["query_id"].map(own.set_index("vec_id")["vector"])
                found.append(best.astype("int64"))
        return pd.concat(found)

    keys = ["cb", "qb", "dim"]
    q = q.withColumn("vector", F.xxhash64("v"))
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long, vector long")
    rank = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by brute force in DuckDB.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
