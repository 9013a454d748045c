"""Tests of the proposals of near copies: their recall at the threshold, their number, and large tries."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import simhash


def five(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    a, b = five(a), five(b)
    return len(a & b) / len(a | b)


def edited(rng, base, kind, least, most):
    """A text whose likeness to base lies between least and most, by one kind of edit."""
    for _ in range(200):
        words, share = list(base), rng.uniform(0.01, 0.3)
        if kind == "scattered":
            for i in rng.sample(range(len(words)), max(1, int(share / 4 * len(words)))):
                words[i] = f"new{rng.random()}"
        elif kind == "block":
            size = max(1, int(share * len(words)))
            at = rng.randrange(len(words) - size + 1)
            words[at : at + size] = [f"new{rng.random()}" for _ in range(size)]
        else:
            words += [f"new{rng.random()}" for _ in range(max(1, int(share * len(words))))]
        if least <= likeness(base, words) <= most:
            return words
    return None


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    out = {}
    for kind in ("scattered", "block", "appended"):
        for band in ((0.80, 0.82), (0.82, 0.86), (0.86, 0.92)):
            own = out[kind, band] = []
            while len(own) < 150:
                base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 600))]
                if words := edited(rng, base, kind, *band):
                    own.append((" ".join(base), " ".join(words)))
    return out


def test_recall_at_the_threshold_for_every_kind_of_edit(spark, pairs):
    flat = [(key, a, b) for key, own in pairs.items() for a, b in own]
    texts = [(2 * i + side, text) for i, (_, a, b) in enumerate(flat) for side, text in enumerate((a, b))]
    root = {r["__q_id"]: r.root for r in simhash.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = {}
    for i, (key, _, _) in enumerate(flat):
        found.setdefault(key, []).append(root[2 * i] == root[2 * i + 1])
    shares = {key: sum(x) / len(x) for key, x in found.items()}
    print(shares)
    assert min(shares.values()) >= 0.95
    assert len(set(root.values())) >= len(flat)  # and nothing else is linked


def sketched(spark, texts):
    rows = [(i, bytearray(simhash.sketch(simhash.hashes(t, 5)[1])), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "n long, mins binary, root long")


def test_unrelated_texts_are_not_proposed_and_proposals_follow_the_number_of_copies(spark, pairs):
    rng = random.Random(12)
    count = {}
    for many in (500, 2000):
        texts = [" ".join(rng.choices([f"v{i}" for i in range(300)], k=rng.randint(20, 200))) for _ in range(many)]
        assert simhash._forest(sketched(spark, texts)).count() == 0
        near = [t for _, own in pairs.items() for pair in own[: many // 100] for t in pair]
        count[many] = simhash._candidates(sketched(spark, texts + near)).count() / len(near)
    assert count[2000] < 1.3 * count[500] < 1.3


def test_large_tries_are_dealt_out_again(spark):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(120):  # one group, which shares most blocks of bits
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(words))
    df = sketched(spark, texts)
    spanned = [simhash.components(simhash._forest(df, hot)) for hot in (100, 200_000)]
    assert [c.select("root").distinct().count() for c in spanned] == [1, 1] and [c.count() for c in spanned] == [120, 120]
    assert simhash._candidates(df.withColumn("root", F.lit(0).cast("long"))).count() == 0


def test_pairs_of_a_clump_that_do_not_link_are_judged_without_being_rows(spark):
    rng = random.Random(14)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(240):  # most lie below 0.8 of each other, and some link
        words = list(base)
        for at in rng.sample(range(120), rng.choice((1, 3, 4, 5))):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    five_of = [five(t.split()) for t in texts]
    links = [(i, k) for i in range(240) for k in range(i) if len(five_of[i] & five_of[k]) / len(five_of[i] | five_of[k]) >= 0.8]
    root = list(range(240))
    for _ in range(240):
        for i, k in links:
            root[i] = root[k] = min(root[i], root[k])
    assert 20 < len(set(root)) < 220
    sets = spark.createDataFrame([(i, len(h), bytearray(h.tobytes())) for i, h in enumerate(simhash.hashes(t, 5)[1] for t in texts)], "n long, size long, shingles binary")
    members = sets.select("n", F.lit(0).cast("long").alias("clump"), F.col("n").alias("root"), "size")
    for many in (512, 64):  # one task, and ten of two blocks each
        met = simhash._met(members, sets, many, 1 << 20)
        assert met.count() == 240 * -(-240 // many) < 240 * 239 / 2 / 20
        edges = simhash._within(members, sets, 0.8, many)
        assert edges.count() <= met.count()
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        assert [got.get(i, i) for i in range(240)] == root
    whole = {r["__q_id"]: r.root for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(zip((whole[i] for i in range(240)), root))) == len(set(root)) == len(set(whole.values()))
