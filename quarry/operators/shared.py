"""What the operators share: the folder of driver and executors, lineage cuts, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


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
    """Write df to the shared folder and go on from there: what is used twice is computed once, and a lost executor
    costs no more than its own tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df marked for broadcast if it has at most so many (short) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def met(few: DataFrame, rows: DataFrame, key: str, most: int = 500_000) -> DataFrame:
    """few (settled) joined to rows by key: rows are chosen by their key before their other columns are computed."""
    return sent(few, most).join(rows.join(sent(few.select(key).distinct(), most), key, "left_semi"), key)


def hadoop(spark: SparkSession, path: str):
    """(file system, path): for names only, never for rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Rename a staged folder to path, which must not be there yet: readers see all of it or nothing."""
    fs, at = hadoop(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    fs.mkdirs(at.getParent())
    if not fs.rename(hadoop(spark, staged)[1], at):
        raise OSError(f"{staged} could not be renamed to {path}")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with the place of each row, from 0, in the given order: a range shuffle, then one count a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("__part", before.alias("__base"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn(out, F.col("__base") + inside).drop("__part", "__base", "__at")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: a lambda that names an expression computes it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
