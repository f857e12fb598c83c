"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vector components become integers, floor(256 x). A component of a query row that is not zero is a
term with a weight; the terms of a block of queries are its postings, held as sparse columns. Each
task reads blocks of candidate rows, scatters for one term after another weight times component into
a dense array of scores (queries by candidates), selects the k highest of each row by partition, and
merges them with the best so far, so that it passes on k rows a query at most. A last window merges
the tasks' rows. Scores are exact integers (int64; int32 where the largest product sum fits).

Queries are the rows whose id is divisible by ``every``. They are processed in blocks of
``QUERY_BLOCK``; a broadcast holds one group of blocks of at most ``GROUP_BYTES``. Further groups are further
passes over the candidates, whose results are written before the next group is fetched, so memory does
not grow with the number of queries. Repeated query rows are one query.

Vectors that are null, or hold a null or a component that is not finite, take no part; nor do rows
without an id. Vectors of another length than the query's score over the common components. Ties go
to the smaller id; rows that repeat an id are candidates each. Fewer than k candidates: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, work_dir, written

K = 5
EVERY = 50
SCALE = 256
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 2048
GROUP_BYTES = 32 << 20


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, integer components) of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v")
    )


def _matrix(col) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(col.offsets.to_numpy())
    if not len(size):
        return np.zeros((0, 0), np.int64)
    width = int(size.max())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def postings(block: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each term, the queries that have it and their weights."""
    out = []
    for t in range(block.shape[1]):
        rows = np.flatnonzero(block[:, t])
        if len(rows):
            out.append((t, rows, block[rows, t]))
    return out


def accumulate(terms: list, n: int, cand: np.ndarray) -> np.ndarray:
    """Dense scores (queries by candidates), one term after another."""
    largest = sum(int(np.abs(w).max()) * int(np.abs(cand[:, t]).max(initial=0)) for t, _, w in terms if t < cand.shape[1])
    kind = np.int32 if largest < 2**31 - 1 else np.int64
    scores = np.zeros((n, len(cand)), kind)
    across = np.ascontiguousarray(cand.T.astype(kind))
    for t, rows, w in terms:
        if t >= len(across):
            break
        if len(rows) == n:
            scores += w.astype(kind)[:, None] * across[t]
        else:
            scores[rows] += w.astype(kind)[:, None] * across[t]
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k highest of each row, equal scores by smaller id."""
    n, m = scores.shape
    if m > k:
        floor = np.partition(scores, m - k, axis=1)[:, m - k]
        r, c = np.nonzero(scores >= floor[:, None])
    else:
        r, c = np.divmod(np.arange(n * m), max(m, 1))
    s, i = scores[r, c].astype(np.int64), ids[c]
    return _cut(r, i, s, k)


def _cut(r: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((i, -s, r))
    r, i, s = r[order], i[order], s[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], i[keep], s[keep]


LOWEST = np.iinfo(np.int64).min


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for frames of (id, v); a query's own id is no candidate.

    Equal query rows are one query; queries of one id with different vectors are ranked each on their own.
    """
    spark = candidates.sparkSession
    queries = queries.select("id", "v").distinct()
    shape = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    per_group = max(QUERY_BLOCK, GROUP_BYTES // (8 * max(1, shape[1])) // QUERY_BLOCK * QUERY_BLOCK)
    groups = max(1, -(-shape[0] // per_group))
    if groups == 1:
        return _group(queries, candidates, k)[0]
    path = work_dir(spark)
    found = []
    for g in range(groups):  # one group at a time is held on the driver and in the tasks
        got, shared = _group(queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(groups)) == g), candidates, k)
        found.append(written(got, f"{path}/group{g}"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def _group(queries: DataFrame, candidates: DataFrame, k: int):
    """The result for queries that fit into one broadcast, and the broadcast."""
    rows = queries.toArrow().combine_chunks()
    q_ids = rows.column("id").to_numpy()
    q = _matrix(rows.column("v").combine_chunks()) if len(q_ids) else np.zeros((0, 1), np.int64)
    shared = candidates.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator):
        import pyarrow as pa

        ids, q = shared.value
        blocks = [(a, ids[a : a + QUERY_BLOCK], postings(q[a : a + QUERY_BLOCK])) for a in range(0, len(ids), QUERY_BLOCK)]
        best = {a: (np.zeros(0, np.int64),) * 3 for a, _, _ in blocks}
        for batch in batches:
            c_ids, c_vec = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for c in range(0, len(c_ids), CANDIDATE_BLOCK):
                some, vec = c_ids[c : c + CANDIDATE_BLOCK], c_vec[c : c + CANDIDATE_BLOCK]
                by_id = np.argsort(some, kind="stable")
                for a, own, terms in blocks:
                    scores = accumulate(terms, len(own), vec).astype(np.int64)
                    lo, hi = np.searchsorted(some[by_id], own, "left"), np.searchsorted(some[by_id], own, "right")
                    for r in np.flatnonzero(hi > lo):
                        scores[r, by_id[lo[r] : hi[r]]] = LOWEST
                    r, i, s = _best(scores, some, k)
                    r, i, s = (x[s > LOWEST] for x in (r, i, s))
                    best[a] = _cut(*(np.concatenate(x) for x in zip(best[a], (r, i, s))), k)
        for a, own, _ in blocks:
            r, i, s = best[a]
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(r + a), pa.array(own[r]), pa.array(i), pa.array(s)], names=["q", "query_id", "vec_id", "score"])

    found = candidates.select("id", "v").mapInArrow(run, "q bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score"), shared


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("id") % EVERY == 0), rows)


SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT id, v, row_number() OVER () AS n FROM (SELECT DISTINCT id, v FROM v WHERE id % 50 = 0)
), s AS (
  SELECT q.n, q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM q JOIN v c ON c.id <> q.id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
