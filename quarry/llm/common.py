"""What the operators share: the shared folder, lineage cuts, distributed numbering and running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stands for a null doc_id in joins, where null would not equal null.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only in a local session."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no more than its own tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fewer(df: DataFrame, rows: int, size: int = 50_000, least: int = 8) -> DataFrame:
    """df in so many tasks as its rows need at `size` rows each, at least `least`; never in more than it has.

    Each task that writes to a shuffle leaves files however little it writes, and what goes through many shuffles leaves them in each.
    """
    return df.coalesce(max(least, -(-rows // size)))


def key_of(doc_id: str = "doc_id", text: str = "text") -> list:
    """Join keys of a document: its id, null made comparable, and a hash of its text.

    Rows equal in both are one document that is repeated.
    """
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("__q_id"), F.xxhash64(F.col(text)).alias("__q_text")]


def join_hot(rows: DataFrame, right: DataFrame, keys: list[str], count: str, parts: int = 1000, how: str = "inner") -> DataFrame:
    """rows joined with right, which has one row for each of keys and, as `count`, how many rows hold it.

    how: "inner", or "left" to keep rows that right has nothing for.

    Keys that hold more than one in `parts` of all counted rows are fewer than `parts`: they are broadcast and their
    rows stay where they are. The others are shuffled, and none of them fills a task. Both inputs should be settled,
    as they are read twice. The column `count` is left out.
    """
    total = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = right.where(F.col(count) > max(1, total // parts))
    cold = right.where(F.col(count) <= max(1, total // parts)).drop(count)
    few = F.broadcast(hot.drop(count))  # fewer than `parts` rows
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how), allowMissingColumns=True)


def global_row_number(df: DataFrame, order: list, out: str) -> DataFrame:
    """Number all rows from 0 in the given order: a range shuffle, then offsets from one count a partition.

    A hot sort key is split wherever a later key of the order tells its rows apart. Rows equal in all keys may
    be numbered either way. The result is settled, so numbers do not change when a task runs again.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__q_at", F.monotonically_increasing_id()))
    part = F.shiftright("__q_at", 33)
    counts = placed.groupBy(part.alias("__q_part")).agg(F.count("*").alias("__q_n"))
    before = F.coalesce(F.sum("__q_n").over(W.orderBy("__q_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("__q_part", before.alias("__q_base"))
    inside = F.col("__q_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__q_part", part).join(base, "__q_part").withColumn(out, F.col("__q_base") + inside).drop("__q_part", "__q_base", "__q_at")


def exclusive_sum(df: DataFrame, groups: list[str], bucket, order: list, value: str, out: str, most: int | None = None) -> DataFrame:
    """Add the sum of value over the rows before each row of its group, in the given order.

    bucket: a column that never falls in that order. Each (group, bucket) is summed on its own, so a hot group is
    spread over all its buckets; the buckets' totals are few and are summed per group.
    most: buckets before which the sum has reached it are left out, before the rows are shuffled; for few groups,
    as the totals, one row for each group and bucket, are broadcast.
    """
    keys = [*groups, "__q_b"]
    cut = df.withColumn("__q_b", bucket)
    totals = cut.groupBy(*keys).agg(F.sum(value).alias("__q_s"))
    wide = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    base = totals.select(*keys, F.coalesce(F.sum("__q_s").over(wide.orderBy("__q_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__q_base"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = cut.join(base, keys) if most is None else cut.join(F.broadcast(base.where(F.col("__q_base") < most)), keys)
    return placed.withColumn("__q_in", inner).withColumn(out, F.col("__q_base") + F.col("__q_in")).drop("__q_b", "__q_base", "__q_in")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of the component.

    Alternates the large-star and small-star steps until nothing changes; each round is settled. Nodes without an
    edge to another node do not appear. Each step runs in as many tasks as its edges need.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = settle(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while seen[0]:
        rows = 2 * seen[0]
        now = fewer(now, rows)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = fewer(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"), rows)
        large = fewer(large.distinct(), rows)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = settle(fewer(fewer(small.select("e.*").where("a != b"), rows).distinct(), rows))
        if (then := state(now)) == seen:
            break
        seen = then
    now = fewer(now, 2 * seen[0])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
