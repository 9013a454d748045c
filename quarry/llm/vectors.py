"""Nearest rows by inner product: blocks of candidates, streamed against queries, and top-k of the blocks' lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids, gid): equal vectors once, with their k + 1 smallest distinct ids, ascending; gid is a 128-bit digest.

    Larger ids can be in nobody's k best. The limit applies before the shuffle too, so a vector that a third of
    all rows share is k + 1 rows a task. Settled.
    """
    order = W.partitionBy("vector").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    out = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return settle(out.withColumn("gid", F.md5(F.concat_ws(",", F.col("vector").cast("array<string>")))))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def stream_blocks(candidates: DataFrame, queries: DataFrame, solve, k: int) -> DataFrame:
    """(qid, score, ids): for each query and block, ids of the candidates that solve names.

    candidates: (block, vector, ids); queries: (block, qid, vector). The rows of a block meet in one task, the
    candidates first; a task holds one block's matrix and one batch of queries at a time.
    solve(M, lows, Q) yields (query index, row indexes, scores).
    """
    left = candidates.select("block", F.lit(None).cast("string").alias("qid"), "vector", "ids")
    right = queries.select("block", "qid", "vector", F.array().cast("array<bigint>").alias("ids"))
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).withColumn("isq", F.col("qid").isNotNull()).repartition(n, "block").sortWithinPartitions("block", "isq")

    def run(batches):
        block, parts, ids, state = None, [], [], None
        for batch in batches:
            keys = np.array(batch.column("block").to_pylist(), dtype=object)
            isq = batch.column("isq").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (isq[1:] != isq[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if keys[a] != block:
                    block, parts, ids, state = keys[a], [], [], None
                piece = batch.slice(a, b - a)
                if not isq[a]:
                    parts.append(matrix(piece.column("vector")))
                    ids += piece.column("ids").to_pylist()
                    continue
                if not parts:
                    continue
                if state is None:
                    state = (np.concatenate(parts), np.array([x[0] for x in ids], np.int64))
                    parts = [state[0]]
                queries, qids = matrix(piece.column("vector")), piece.column("qid").to_pylist()
                out = [(qids[i], s, ids[r]) for i, rows, scores in solve(*state, queries) for r, s in zip(rows, scores)]
                if out:
                    q, s, x = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array([float(y) for y in s]), pa.array(x, pa.list_(pa.int64()))], ["qid", "score", "ids"])

    return both.mapInArrow(run, "qid string, score double, ids array<long>")


def scan_blocks(candidates: DataFrame, queries: DataFrame, opened, schema: str, parts: int | None = None) -> DataFrame:
    """What the blocks of candidates yield: each block is read whole by one task, and then its queries, batch by batch.

    candidates and queries carry the column block, of one type, and columns of their own. opened(candidates), of a
    pyarrow table of one block, gives an object whose ask(queries), of a table, and end() yield record batches of schema.
    A task holds one block and one batch of queries at a time. Queries of a block without candidates yield nothing.
    """
    n = parts or int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.struct(*[c for c in df.columns if c != "block"]) for df in (candidates, queries)]
    kind = [df.select(c.alias("c")).schema["c"].dataType for df, c in zip((candidates, queries), own)]
    left = candidates.select("block", F.lit(False).alias("asks"), own[0].alias("c"), F.lit(None).cast(kind[1]).alias("q"))
    right = queries.select("block", F.lit(True).alias("asks"), F.lit(None).cast(kind[0]).alias("c"), own[1].alias("q"))
    both = left.unionByName(right).repartition(n, "block").sortWithinPartitions("block", "asks")

    def flat(pieces):
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in pieces]).combine_chunks()

    def run(batches):
        at, held, state = None, [], None
        for batch in batches:
            block, asks = batch.column("block").to_pylist(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [i for i in range(1, len(block)) if block[i] != block[i - 1] or asks[i] != asks[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(block)]):
                if a == b:
                    continue
                if block[a] != at:
                    if held or state:
                        state = state or opened(flat(held))
                        yield from state.end()
                    at, held, state = block[a], [], None
                if not asks[a]:
                    held.append(batch.column("c").slice(a, b - a))
                    continue
                if held:
                    state, held = opened(flat(held)), []
                if state:
                    yield from state.ask(flat([batch.column("q").slice(a, b - a)]))
        if held or state:
            yield from (state or opened(flat(held))).end()

    return both.mapInArrow(run, schema)


def top(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of the blocks' lists for every query id of members (qid, query_id).

    A query's own id is left out, ties go to the smaller id. The lists of equal queries are cut to k + 1 first.
    """
    one = found.select("qid", "score", F.explode("ids").alias("vec_id"))
    by = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    few = one.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).drop("n")
    own = members.join(few, "qid").where("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
