"""Approximate nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a router to it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table
from .vectors import distinct_vectors, matrix, stream_blocks, top


def neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k + 1 largest inner products of each query (a query that is a row finds itself as well)."""
    k = min(k + 1, len(x))
    return np.concatenate([np.argpartition(-(queries[i : i + 128] @ x.T), k - 1, axis=1)[:, :k] for i in range(0, len(queries), 128)])


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row of the neighbour graph: few edges between parts, none over slack times the mean size.

    Starts from cuts at quantiles of principal axes, then rows move to the part most of their neighbours are in,
    those that gain most first, as long as it has room.
    """
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        order, at = rows[np.argsort(y @ axis, kind="stable")], len(rows) * (n // 2) // n
        todo += [(order[:at], first, n // 2), (order[at:], first + n // 2, n - n // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                part[i] = best[i]
                sizes[part[i]] += 1
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier with one hidden layer: a vector's probability of each part."""

    def __init__(self, x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale = 1 / max(1e-12, float(np.sqrt((x**2).mean())))
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, goal.shape[1])), np.zeros(goal.shape[1])]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                at = order[i : i + 256]
                a = x[at] * self.scale
                h = np.maximum(a @ w[0] + w[1], 0)
                d = (_softmax(h @ w[2] + w[3]) - goal[at]) / len(at)
                dh = (d @ w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((a.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    g = g + 1e-4 * w[j]
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    w[j] -= 3e-3 * (1 - epoch / epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the most probable first, ties to the smaller number."""
        h = np.maximum(x * self.scale @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, parts: int, k: int, recall: float, probe_rows: int = 1024) -> tuple[Router, int]:
    """A router fitted on rows of x, and the number of parts to search for this recall of the k nearest.

    The classifier learns from each row its own part and those of its graph neighbours. The last rows, an eighth and
    probe_rows at most, are kept from it: the number of parts is measured on them, against all rows of x, each row
    in the part that the router gives it.
    """
    held = min(probe_rows, len(x) // 8)
    own = x[: len(x) - held]
    graph = neighbours(own, own, 10)
    part = balanced_parts(own, graph, parts)
    goal = np.zeros((len(own), parts))
    np.add.at(goal, (np.repeat(np.arange(len(own)), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    goal[np.arange(len(own)), part] += 1
    router = Router(own, goal / 2 if parts > 1 else goal / goal.sum(1, keepdims=True))
    ranks = router.ranked(x)
    probes = np.arange(len(x) - held, len(x)) if held else np.arange(len(x))
    near = neighbours(x, x[probes], k)
    place = np.argsort(ranks[probes], axis=1)  # of each part in a probe's ranking
    own = near == probes[:, None]
    at = np.where(own, -1, np.take_along_axis(place, ranks[:, 0][near], axis=1))
    for n in range(1, parts + 1):
        if ((at >= 0) & (at < n)).sum() >= recall * (~own).sum():
            break
    return router, n


def nearest(block: np.ndarray, lows: np.ndarray, query: np.ndarray, rough: np.ndarray, k: int):
    """(rows, scores) of the k best of a block; scores are summed dimension by dimension, so equal rows score alike."""
    if len(rough) > k:
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        rows = np.flatnonzero(rough >= kth - 1e-9 * (1 + abs(kth)))
    else:
        rows = np.arange(len(rough))
    scores = np.zeros(len(rows))
    for d in range(block.shape[1]):
        scores += block[rows, d] * query[d]
    best = np.lexsort((lows[rows], -scores))[:k]
    return rows[best], scores[best]


def search(rows: DataFrame, is_query, k: int = 20, sample: int = 4096, recall: float = 0.93, block_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product for each query row.

    rows: id, vector (array<double>, finite, not all zero). is_query: a condition on id. Queries look for every
    row but those of their own id; ties go to the smaller id. Rows whose id or vector is null take no part; a
    vector meets only those of its own length; repeated rows are one; an empty table gives no rows.

    Partitions are learned on a sample of at most `sample` distinct vectors (the smallest digests): as many as the root
    of the table's vectors, so that lists for each query and part do not grow with the square of the table, with 48 of
    the sample to each at least. The number of parts to search is the
    smallest that finds the share `recall` of true neighbours of sampled rows that the router has not seen. Every
    row is indexed by the router. A part of any size is searched in blocks of about block_rows vectors.
    """
    groups = distinct_vectors(rows.where("id is not null and vector is not null and size(vector) > 0"), k)
    members = groups.select("gid", "vector").join(rows.where(is_query).where("vector is not null").distinct(), "vector").select(F.col("gid").alias("qid"), F.col("id").alias("query_id"))
    wanted = settle(members.select("qid").distinct())
    found = None
    for (length, count) in groups.groupBy(F.size("vector")).count().collect():
        of_length = groups.where(F.size("vector") == length)
        x = matrix(of_length.orderBy("gid", "vector").limit(sample).select("vector").toArrow().column("vector").combine_chunks())
        router, probes = fit(x, max(1, min(int(count**0.5), len(x) // 48)), k, recall)

        def route(batches, router=router, probes=probes):
            for batch in batches:
                parts = router.ranked(matrix(batch.column("vector")))[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "parts"])

        placed = settle(of_length.mapInArrow(route, "vector array<double>, ids array<long>, gid string, parts array<int>"))
        sizes = placed.groupBy(F.col("parts")[0].alias("part")).count().collect()  # a row for each part
        cut = F.create_map(*[F.lit(v) for r in sizes for v in (r[0], max(1, -(-r[1] // block_rows)))])
        name = lambda part, i: F.concat_ws(":", part, i)
        own = F.col("parts")[0]
        candidates = placed.select("vector", "ids", name(own, F.pmod(F.xxhash64("gid"), cut[own])).alias("block"))
        asked = placed.join(wanted, placed.gid == wanted.qid, "left_semi").select("vector", F.col("gid").alias("qid"), F.explode("parts").alias("part")).where(cut[F.col("part")].isNotNull())
        queries = asked.withColumn("i", F.explode(F.sequence(F.lit(0), cut[F.col("part")] - 1))).select("vector", "qid", name(F.col("part"), F.col("i")).alias("block"))

        def solve(block, lows, queries):
            for i in range(0, len(queries), 64):
                rough = queries[i : i + 64] @ block.T
                for j, q in enumerate(queries[i : i + 64]):
                    yield i + j, *nearest(block, lows, q, rough[j], k + 1)

        one = stream_blocks(candidates, queries, solve, k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return members.select("query_id", F.lit(0).alias("rank"), F.col("qid").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    return top(found, members, k)


def op10_learned_partitions(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every query; vectors that are null, zero or not finite take no part."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return search(rows.where(finite), F.col("id") % 20 == 0)
