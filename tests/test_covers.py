"""Tests of cover density against a sweep that tries every stretch."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import covers, retrieval


def kept(tokens, term):
    at = sorted({min(i, covers.LAST_POSITION) for i, t in enumerate(tokens, 1) if t == term})
    return at[: covers.MOST_POSITIONS]


def plain(tokens, terms, need):
    """The rank by all stretches of positions: a cover has what is needed, and no shorter stretch within it has."""
    lists = [kept(tokens, t) for t in sorted(set(terms))]
    if need == "any":
        return sum(0.1 for at in lists for _ in at) or None
    if not all(lists):
        return None
    every = sorted(p for at in lists for p in at)
    full = [(a, b) for a in set(every) for b in set(every) if a <= b and all(any(a <= p <= b for p in at) for at in lists)]
    least = [(a, b) for a, b in full if not any((a, b) != (c, d) and a <= c and d <= b for c, d in full)]
    held = {(a, b): sum(a <= p <= b for p in every) for a, b in least}
    noise = {(a, b): (b - a) - (h - 1) if b - a >= h - 1 else (h - 1) // 2 for (a, b), h in held.items()}
    return sum(0.1 / (1 + noise[c]) for c in least)


@pytest.mark.parametrize("need", ["any", "all"])
def test_rank_is_that_of_a_sweep(spark, need):
    rng = random.Random(6)
    texts = {f"c{i}": rng.choices("abcdef", k=rng.randint(0, 25)) for i in range(60)}
    texts |= {"long": ["z"] * 17_000 + ["a", "b", "a"], "many": ["a"] * 400 + ["b"] * 3, "none": []}
    asked = {1: ["a", "b", "b"], 2: ["c"], 3: ["a", "e", "f"], 4: ["nowhere", "a"], 5: [], 6: ["z", "b"]}
    chunks = spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(texts.items())], "chunk_id string, ord long, tokens array<string>")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    got = {(r.query_id, r.chunk_id): r.score for r in covers.cover_density(chunks, queries, need).collect()}
    want = {(q, c): s for q, terms in asked.items() if terms for c, t in texts.items() if (s := plain(t, terms, need)) is not None}
    assert got == pytest.approx(want)


def test_nearer_terms_rank_higher_and_scopes_come_first(spark):
    rows = [("far", 0, "x", "a q q q b".split()), ("near", 1, "x", "q a b q q".split()), ("other", 2, "y", "a b a b".split())]
    chunks = spark.createDataFrame(rows, "chunk_id string, ord long, s string, tokens array<string>")
    queries = spark.createDataFrame([(1, "x", ["a", "b"])], "query_id long, s string, terms array<string>")
    got = retrieval.fulltext(chunks, queries, k=1, need="all", scope=["s"]).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("near", 0.1)]
    assert [r.chunk_id for r in retrieval.fulltext(chunks, queries, need="all").orderBy("rank").collect()] == ["other", "near", "far"]
    with pytest.raises(ValueError, match="unknown need"):
        covers.cover_density(chunks, queries, "some")


def test_empty_tables(spark):
    chunks = spark.createDataFrame([], "chunk_id string, ord long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>")
    for need in ("any", "all"):
        assert covers.cover_density(chunks, queries, need).count() == 0
        assert covers.cover_density(chunks.limit(0), queries.where(F.lit(False)), need).count() == 0
