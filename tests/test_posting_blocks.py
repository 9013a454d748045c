"""Postings are no rows of a shuffle."""

import random

from pyspark.sql import functions as F

from quarry.operators import index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_postings_are_those_of_counted_tokens(spark):
    rng = random.Random(4)
    rows = [(int(i * 3), i % 5, rng.choices([f"w{j}" for j in range(30)] + ["é", "一丁"], k=rng.randint(0, 25)) if i % 17 else None) for i in range(700)]
    chunks = spark.createDataFrame(rows, "ord long, code int, tokens array<string>").repartition(5)
    made = index.posting_blocks(chunks, 8, 64)
    text = plan(made)
    assert "Generate" not in text and "collect_list" not in text
    want = {}
    for o, code, tokens in rows:
        for t in set(tokens or []):
            want.setdefault((t, o // 64), []).append((o, tokens.count(t), len(tokens), code))
    got = made.collect()
    assert len(got) == len(want)
    for r in got:
        own = sorted(want[r.term, r.stretch])
        assert [tuple(x) for x in r.rows] == own and r.n == len(own) and r.max_tf == max(x[1] for x in own) and r.min_len == min(x[2] for x in own)
        assert (r.best.tf, -r.best.len) == max((x[1], -x[2]) for x in own)
    assert made.select(F.pmod(F.xxhash64("term"), F.lit(8)) == F.col("bucket")).distinct().collect()[0][0]
    assert index.posting_blocks(chunks.limit(0), 8, 64).count() == 0


def test_postings_are_shuffled_once_and_pieces_of_a_block_joined(spark):
    rows = [(i, i % 3, [f"w{(i * j) % 7}" for j in range(9)]) for i in range(500)]
    chunks = spark.createDataFrame(rows, "ord long, code int, tokens array<string>").repartition(6)  # scattered on purpose
    whole, pieces = index.posting_blocks(chunks, 4, 128), index.posting_blocks(chunks, 4, 128, most=40)
    assert plan(index.posting_blocks(spark.createDataFrame(rows, "ord long, code int, tokens array<string>"), 4, 128)).count("Exchange") == 1
    got = sorted(pieces.collect(), key=lambda r: (r.term, r.stretch))
    assert got == sorted(whole.collect(), key=lambda r: (r.term, r.stretch))
    assert len({(r.term, r.stretch) for r in got}) == len(got) == 28 and sum(r.n for r in got) == sum(len(set(t)) for *_, t in rows)
    assert all([x.ord for x in r.rows] == sorted(x.ord for x in r.rows) for r in got)
