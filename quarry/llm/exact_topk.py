"""Exact top-k by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .vectors import distinct_vectors, stream_blocks, top


def threshold_topk(block: np.ndarray, lists: np.ndarray, lows: np.ndarray, query: np.ndarray, k: int, first: int = 16):
    """(rows, scores) of the k best rows of block by inner product, ties to smaller lows.

    lists[:, d] are the rows in ascending order of dimension d; a list is read from the end that the sign of the
    query's component favours. Rows met in any list are scored at once; the sum of what stands at the lists'
    current depth bounds all unmet rows. It stops when that bound is below the k-th score (at equality an unmet
    row could still win its tie), or when the lists end.
    """
    n = len(block)
    dims = np.flatnonzero(query)
    met, depth, step = np.zeros(n, bool), 0, first
    rows, scores = np.zeros(0, np.int64), np.zeros(0, block.dtype)
    if not len(dims):
        rows = np.argsort(lows, kind="stable")[:k]
        return rows, np.zeros(len(rows), block.dtype)
    up = query[dims] < 0
    while depth < n:
        end = min(n, depth + step)
        new = np.unique(np.concatenate([lists[depth:end, dims[up]].ravel(), lists[n - end : n - depth, dims[~up]].ravel()]))
        new = new[~met[new]]
        met[new] = True
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, block[new] @ query])
        if len(rows) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= kth
            rows, scores = rows[keep], scores[keep]
        depth, step = end, step * 2
        if len(rows) >= k and depth < n:
            edge = np.where(up, lists[depth - 1, dims], lists[n - depth, dims])
            bound = (block[edge, dims] * query[dims]).sum()
            if bound < scores.min():
                break
    best = np.lexsort((lows[rows], -scores))[:k]
    return rows[best], scores[best]


def exact_topk(rows: DataFrame, is_query, k: int = 10, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of whole-number vectors for each query row.

    rows: id, vector (array<double> of whole numbers). is_query: a condition on id. Queries look at every row but
    those of their own id, ties go to the smaller id, fewer candidates give fewer rows. Rows whose id or vector is
    null take no part; a vector meets only vectors of its own length; repeated rows are one. An empty table gives
    no rows. Inner products must stay below 2**53, where doubles are exact.

    Blocks of candidates are dealt out by hash; the distinct query vectors go to every block, which runs the
    threshold algorithm for each; the lists' bests meet per query.
    """
    groups = distinct_vectors(rows.where("id is not null and vector is not null and size(vector) > 0"), k)
    blocks = max(1, -(-groups.count() // block_rows))
    members = groups.select("gid", "vector").join(rows.where(is_query).where("vector is not null").distinct(), "vector").select(F.col("gid").alias("qid"), F.col("id").alias("query_id"))
    wanted = members.select("qid").distinct()
    block = lambda i: F.concat_ws(":", F.size("vector"), i)
    candidates = groups.withColumn("block", block(F.pmod(F.xxhash64("gid"), F.lit(blocks))))
    queries = groups.join(wanted, groups.gid == wanted.qid, "left_semi").select("vector", F.col("gid").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i")).withColumn("block", block(F.col("i")))

    def solver():
        kept = {}

        def solve(block, lows, queries):
            if kept.get("of") is not block:
                kept.update(of=block, lists=np.argsort(block, axis=0, kind="stable"))
            for i, q in enumerate(queries):
                yield i, *threshold_topk(block, kept["lists"], lows, q, k + 1)

        return solve

    return top(stream_blocks(candidates, queries, solver(), k), members, k)


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best of every query, ties to the smaller vec_id; vectors that are null or not finite take no part."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("vector", lambda x: F.floor(x * 1024).cast("double"))
    # floor gives a long: components of 9e15 and more in size would be cut off there, and sums exceed 2**53 long before
    rows = rows.where(finite).select("id", whole.alias("vector"))
    return exact_topk(rows, F.col("id") % 100 == 0).withColumn("score", F.col("score").cast("long"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
