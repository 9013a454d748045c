"""Tests of hard negatives by slots, against a plain loop over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives

COLS = "vec_id long, embedding array<float>, label int, gid string, slot int, n int, upper array<long>"


def plain(rows, positives=5, negatives=10, low=30, high=90, every=100):
    """rows: (id, label, whole-number vector), without nulls."""
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows})
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            window = [(n, i) for n, i, other in scored if other != label and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(window[:negatives], 1)]
    return out


def test_windows_ties_and_hot_vectors(spark):
    rng = random.Random(2)
    hot = [3, 1, 0, 2]
    rows = [(i, rng.randint(0, 2), hot if i % 3 == 0 else [rng.randint(-3, 4) for _ in range(4)]) for i in range(400)]
    rows += rows[:30] + [(500 + i, 1, [1.0, 2.0]) for i in range(5)] + [(600, 5, [1, 1, 1, 1])]
    df = spark.createDataFrame([(i, label, [float(x) for x in v]) for i, label, v in rows], "id long, label long, vector array<double>")
    df = df.unionByName(spark.createDataFrame([(None, 1, [1.0] * 4), (700, None, [1.0] * 4), (800, 1, None), (900, 1, [])], df.schema))
    for blocks in (64, 100_000):
        got = hard_negatives.hard_negatives(df, F.col("id") % 20 == 0, block_rows=blocks)
        assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows, every=20))


def test_other_windows(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.randint(0, 9) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame([(i, label, [float(x) for x in v]) for i, label, v in rows], "id long, label long, vector array<double>")
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, positives=3, negatives=4, low=0, high=120, block_rows=40)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows, 3, 4, 0, 120, 10))


def test_query_with_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(4)
    good = [(i, [rng.random() - 0.3 for _ in range(4)], i % 4) for i in range(300)]
    odd = [(1000, None, 1), (1100, [1.0, None, 0.0, 0.0], 1), (1200, [float("nan")] * 4, 1), (1300, [float("inf"), 0.0, 0.0, 0.0], 2), (None, [0.5] * 4, 1), (1400, [0.5] * 4, None)]
    df = spark.createDataFrame([(i, v, label, "g", 1, 2, [3]) for i, v, label in good + odd], COLS)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    floats = {r.vec_id: r.embedding for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()}
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(256 * x // 1) for x in floats[i]]) for i, _, label in good]
    assert sorted(tuple(r) for r in hard_negatives.op13_hard_negatives(spark, str(tmp_path)).collect()) == sorted(plain(rows))


def test_empty_table_and_vectors_that_are_too_long(spark, tmp_path):
    spark.createDataFrame([], COLS).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert hard_negatives.op13_hard_negatives(spark, str(tmp_path)).count() == 0
    df = spark.createDataFrame([(0, 1, [1e12])], "id long, label long, vector array<double>")
    with pytest.raises(Exception, match="too long"):
        hard_negatives.hard_negatives(df, F.lit(True)).collect()
