"""Hard negatives by slots: what the positives allow cuts the scores into disjoint slots, and each keeps its own best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, settle, table
from .vectors import matrix, scan_blocks

FOUND = "gid string, slot int, score long, ids array<long>"


def best_rows(scores: np.ndarray, lows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties to smaller lows."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((lows[at], -scores[at]))[:k]]


class Block:
    """One block of candidates (label, vector, ids), asked by anchors.

    Without upper limits an anchor (gid, label, vector) gets its k best of its own label, in slot 0. With limits
    (upper: descending and distinct; least) it gets the k best of other labels in each slot: slot j holds the scores
    above the next limit and not above upper[j]; scores under least are in no window.
    """

    def __init__(self, candidates: pa.Table, k: int, mine: bool):
        self.x = matrix(candidates.column("vector").combine_chunks())
        self.label = candidates.column("label").to_numpy()
        self.ids = candidates.column("ids").combine_chunks()
        self.lows = self.ids.values.to_numpy()[self.ids.offsets.to_numpy()[:-1]]
        self.k, self.mine = k, mine

    def ask(self, queries: pa.Table):
        x, label, gid = matrix(queries.column("vector").combine_chunks()), queries.column("label").to_numpy(), queries.column("gid")
        limits = [] if self.mine else queries.column("upper").to_pylist()
        least = [] if self.mine else queries.column("least").to_numpy()
        for i in range(0, len(x), 128):
            scores = x[i : i + 128] @ self.x.T
            which, slots, rows = [], [], []
            for q, s in enumerate(scores, i):
                same = self.label == label[q]
                if self.mine:
                    fit, slot = np.flatnonzero(same), None
                else:
                    upper = np.array(limits[q], np.float64)
                    fit = np.flatnonzero(~same & (s <= upper[0]) & (s >= least[q]))
                    slot = len(upper) - 1 - np.searchsorted(upper[::-1], s[fit], "left")
                for j in [0] if slot is None else np.unique(slot):
                    at = fit if slot is None else fit[slot == j]
                    at = at[best_rows(s[at], self.lows[at], self.k)]
                    which.append(np.full(len(at), q))
                    slots.append(np.full(len(at), j, np.int32))
                    rows.append(at)
            if rows and sum(map(len, rows)):
                q, r = np.concatenate(which), np.concatenate(rows)
                cols = [gid.take(pa.array(q)).combine_chunks(), pa.array(np.concatenate(slots)), pa.array(scores[q - i, r].astype(np.int64)), self.ids.take(pa.array(r))]
                yield pa.RecordBatch.from_arrays(cols, ["gid", "slot", "score", "ids"])

    def end(self):
        return ()


def _kept(found: DataFrame, k: int) -> DataFrame:
    """(gid, slot, score, vec_id): the k best of the blocks' lists in every slot, ties to the smaller id."""
    order = W.partitionBy("gid", "slot").orderBy(F.desc("score"), "vec_id")
    one = found.select("gid", "slot", "score", F.explode("ids").alias("vec_id"))
    return one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 32768) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label, vector (array<double> of whole numbers); is_anchor: a condition on id. Scores are inner products,
    the higher first, ties to the smaller id. An anchor's positives are its best `positives` other rows of its label;
    for each, the best `negatives` rows of other labels whose score is from low to high percent of the positive's (of
    a negative score nothing is). Rows whose id, label or vector is null take no part; repeated rows are one; a row is
    never its anchor's positive under its own id; a vector meets only those of its own length; an empty table gives
    no rows. A vector whose squares add up to over 2**46 fails the job: up to there percentages of scores are exact doubles.

    Equal vectors of one label are searched once, with as many of their ids as can matter. The positives' upper limits
    cut an anchor's scores into slots. Each block keeps the best of each slot before anything is shuffled, the blocks'
    lists are merged for each slot, and a positive's window is a suffix of the slots in descending order, cut at its
    lower limit. The best positives + 1 of equal anchors serve each of them, without its own id.
    """
    k = max(positives, negatives) + 1
    whole = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) <= float(2**46)
    sound = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a vector is too long for exact whole-number scores")))
    gid = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")))
    base = rows.where("id is not null and label is not null and vector is not null and size(vector) > 0").where(sound).select("id", F.col("label").cast("long").alias("label"), "vector", gid.alias("gid"))
    order = F.row_number().over(W.partitionBy("gid").orderBy("id"))
    few = base.dropDuplicates(["gid", "id"]).withColumn("n", order).where(F.col("n") <= k)
    groups = settle(few.groupBy("gid").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids")))
    members = settle(base.where(is_anchor).select("gid", "id").distinct())
    asked = settle(groups.join(members.select("gid").distinct(), "gid", "left_semi").drop("ids"))

    blocks = max(1, -(-groups.count() // block_rows))
    name = lambda i: F.concat_ws(":", F.size("vector"), i)
    candidates = groups.select(name(F.pmod(F.xxhash64("gid"), F.lit(blocks))).alias("block"), "label", "vector", "ids")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    to_all = lambda df: df.withColumn("i", every).withColumn("block", name(F.col("i"))).drop("i")

    near = settle(_kept(scan_blocks(candidates, to_all(asked), lambda c: Block(c, positives + 1, True), FOUND), positives + 1))
    share = lambda p, s: F.floor((F.lit(p) * s - F.pmod(F.lit(p) * s, F.lit(100))) / 100).cast("long")
    limits = near.where("score >= 0").groupBy("gid").agg(F.reverse(F.array_sort(F.collect_set(share(high, F.col("score"))))).alias("upper"), F.min(-share(-low, F.col("score"))).alias("least"))
    far = _kept(scan_blocks(candidates, to_all(asked.join(limits, "gid")), lambda c: Block(c, negatives, False), FOUND), negatives)

    first = near.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("vec_id").alias("id")))).alias("positives"))
    slots = far.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), F.col("vec_id").alias("id")))).alias("slots"))
    many = members.groupBy("gid").agg(F.count("*").alias("__q_n"))
    lists = settle(first.join(slots, "gid").join(limits.select("gid", "upper"), "gid").join(many, "gid"))
    each = join_hot(members.withColumnRenamed("id", "anchor_id"), lists, ["gid"], "__q_n")
    others = F.slice(F.filter("positives", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    each = each.select("anchor_id", "upper", "slots", F.explode(others).alias("p")).withColumn("s", -F.col("p.down"))
    each = each.where("s >= 0").withColumn("slot", (F.array_position("upper", share(high, F.col("s"))) - 1).cast("int"))
    suffix = F.slice(F.filter("slots", lambda x: x["slot"] >= F.col("slot")), 1, negatives)
    window = F.filter(suffix, lambda x: x["down"] * -100 >= F.col("s") * low)
    out = each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("s").alias("positive_score"), F.posexplode(window).alias("i", "n"))
    return out.select("anchor_id", "positive_id", (F.col("i") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """For every anchor its 5 positives, and for each of them the 10 best of its window, as hard_negatives() says.

    Rows with a null id or label, or a vector that is null, empty or not finite, take no part.
    """
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(finite).select("id", moved.alias("label"), F.transform("vector", lambda x: F.floor(x * 256).cast("double")).alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other_id, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id != c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
neg AS (
  SELECT p.*, n.other_id AS negative_id, n.score AS negative_score,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank
  FROM pos p JOIN scored n USING (anchor_id) WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""
