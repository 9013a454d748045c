"""Connected components: a round of few edges is few tasks, however many partitions a shuffle has."""

import random

from pyspark.sql import functions as F

from quarry.llm.common import components

STRICT = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def test_few_edges_leave_few_shuffle_files(spark):
    rng = random.Random(5)
    names = rng.sample(range(10_000), 400)
    chains = [names[i : i + 20] for i in range(0, 400, 20)]
    edges = [(a, b) for c in chains for a, b in zip(c, c[1:])] + [(names[0], names[0])]
    rng.shuffle(edges)
    before, sc = {k: spark.conf.get(k) for k in STRICT}, spark.sparkContext
    try:
        for k, v in STRICT.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "")
        out = components(spark.createDataFrame(edges, "a long, b long").coalesce(2))
        sc.setLocalProperty("spark.jobGroup.id", None)
        got = {r.node: r.root for r in out.collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: min(c) for c in chains for n in c}
    # after the first distinct no stage may have a task for each of the 101 partitions
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds}
    wide = [s for s in stages if (i := status.getStageInfo(s)) and i.numTasks > 16 and i.numCompletedTasks]
    assert len(stages) > 12 and len(wide) <= 3, (len(stages), len(wide))


def test_components_of_many_edges_stay_whole(spark):
    from quarry.llm import common

    rows = spark.range(60_000).select(F.col("id").alias("a"), (F.col("id") - F.when(F.col("id") % 6 > 0, 1).otherwise(0)).alias("b"))
    got = common.components(rows)
    assert got.count() == 60_000 and got.where("root != node - node % 6").isEmpty()
