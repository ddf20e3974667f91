"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments. Of each segment the mean and the deviation (root of the summed
squares around the mean) are kept. By Cauchy-Schwarz the inner product of two segments of n components is at
most n * mean * mean + deviation * deviation, which is the lower bound on their squared distance seen from
the other side. Within a block of queries against a block of rows, the bound on one segment picks first
rows, whose exact scores give each query a threshold; rows whose bound falls below it go, segment count by
segment count; what survives is computed exactly in integers. Bounds carry a margin for rounding, and
equal bounds survive, so the result is exact, ties included.

Queries are cut into blocks of `query_block` vectors, and rows are dealt at random into blocks of `row_block`; each
pair of blocks is one task's group, so a task holds two bounded blocks however large the tables are.
The k best of each block are ranked again over all blocks.

Defined cases: vectors that are null, or hold null or non-finite components, take no part. Vectors with a component of
2**26 or more are scored in whole numbers of any size, without bounds; a score among the best that leaves 64 bits
ends the job with an error. Empty vectors score 0; vectors meet only vectors of their own length. Rows that repeat a vec_id are candidates each, but a query's own id
is never its candidate; a repeated query id is answered once, by the least of its vectors. An empty table
gives no row. Only vec_id and embedding are read, so other columns cannot clash.
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.llm.registry import query, table
from weekwatch.session import cut_lineage

K, SCALE, EVERY = 10, 1024, 100
QUERY_BLOCK, ROW_BLOCK = 512, 8192
SEGMENTS = (1, 4, 16)
LARGEST = 1 << 26


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    # doubles hold these whole numbers exactly; from 2**53 on every double is one
    whole = lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)
    v = F.transform(x, lambda c: whole(c * float(scale)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, v).alias("v")).where("v is not null").withColumn("dim", F.size("v"))


def _statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row, and the segments' lengths."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / n
    centred = x - np.repeat(mean, n, axis=1)
    return mean, np.sqrt(np.add.reduceat(centred * centred, cuts[:-1], axis=1)), n


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def block_top_k(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of each query's k best among the block's rows."""
    out: list[tuple[int, int, int]] = []
    if not len(r_ids) or not len(q_ids):
        return out
    if q.shape[1] == 0:
        for qid in q_ids.tolist():
            others = np.sort(r_ids[r_ids != qid])[:k]
            out += [(qid, int(i), 0) for i in others]
        return out
    qf, rf = q.astype(np.float64), r.astype(np.float64)
    levels = [(_statistics(qf, s), _statistics(rf, s)) for s in SEGMENTS]
    # all scores stay below 2**53 only for small components; the margin covers the rounding of the bounds
    margin = 1e-9 * (np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(rf, axis=1).max()) + 1e-3

    def bound(level: int, i: int, rows: np.ndarray) -> np.ndarray:
        (qm, qd, n), (rm, rd, _) = levels[level]
        return rm[rows] @ (qm[i] * n) + rd[rows] @ qd[i]

    (qm, qd, n), (rm, rd, _) = levels[0]
    coarse = (qm * n) @ rm.T + qd @ rd.T
    for i, qid in enumerate(q_ids.tolist()):
        rows = np.flatnonzero(r_ids != qid)
        if len(rows) > k:
            first = rows[np.argpartition(-coarse[i, rows], k - 1)[:k]]
            # sharpen the threshold at the finest level before the rows are thinned out
            least = (r[first] @ q[i]).min()
            rows = rows[coarse[i, rows] + margin[i] >= least]
            for level in range(1, len(SEGMENTS)):
                b = bound(level, i, rows)
                if len(rows) > k:
                    top = rows[np.argpartition(-b, k - 1)[:k]]
                    least = max(least, (r[top] @ q[i]).min())
                rows = rows[b + margin[i] >= least]
        scores = r[rows] @ q[i]
        at = _best(r_ids[rows], scores, k)
        out += [(qid, int(a), int(s)) for a, s in zip(r_ids[rows][at], scores[at])]
    return out


def large_top_k(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same in whole numbers of any size, every query against every row."""
    out: list[tuple[int, int, int]] = []
    rows = [[int(c) for c in x] for x in r.tolist()]
    for qid, x in zip(q_ids.tolist(), q.tolist()):
        x = [int(c) for c in x]
        scores = sorted((-sum(map(operator.mul, x, y)), i) for i, y in zip(r_ids.tolist(), rows) if i != qid)[:k]
        if scores and (scores[0][0] <= -(2**63) or scores[-1][0] > 2**63):
            raise OverflowError(f"a score of query {qid} leaves 64 bits")
        out += [(qid, i, -s) for s, i in scores]
    return out


def _block_join(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(queries) and len(rows):
            q, r = (np.stack(f["v"].to_list()).astype(np.float64) for f in (queries, rows))
            q_ids, r_ids = queries["vec_id"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
            q_large, r_large = ((np.abs(x) >= LARGEST).any(axis=1) for x in (q, r))
            found = block_top_k(q_ids[~q_large], q[~q_large].astype(np.int64), r_ids[~r_large], r[~r_large].astype(np.int64), k)
            found += large_top_k(q_ids[q_large], q[q_large], r_ids, r, k)
            found += large_top_k(q_ids[~q_large], q[~q_large], r_ids[r_large], r[r_large], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) from integer vectors (vec_id, v, dim)."""
    one_each = queries.groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("s")).select("vec_id", "s.v", "s.dim")
    rows, queries = cut_lineage(rows), cut_lineage(one_each)
    n_rows, n_queries = rows.count(), queries.count()
    q_blocks, r_blocks = -(-n_queries // query_block) or 1, -(-n_rows // row_block) or 1

    def dealt(n: int, salt: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    # each block of rows meets each block of queries once
    q = queries.select("vec_id", "v", "dim", dealt(q_blocks, seed).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))).alias("rb"))
    # rand deals rows that repeat one id apart
    r = rows.select("vec_id", "v", "dim", F.floor(F.rand(seed) * r_blocks).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    schema = "query_id long, vec_id long, score long"
    found = q.groupBy("dim", "qb", "rb").cogroup(r.groupBy("dim", "qb", "rb")).applyInPandas(_block_join(k), schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM r q JOIN r ON q.vec_id % {EVERY} = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= {K}
"""


@query("op5_exact_top_k", ORACLE)
def op5(spark, sf_dir):
    """The ten best of every hundredth vector among all others."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(EVERY)) == 0))
