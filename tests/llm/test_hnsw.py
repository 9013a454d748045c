"""Tests of near-duplicate vectors by graphs of shards, against the cosines of all pairs."""

import numpy as np
import pyarrow as pa

from quarry.llm import hnsw

SF = "/root/testdata/sf0.001"
COLS = "vec_id long, embedding array<double>, label int, n long, i int, root long, copies long, id string"


def plain(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) of rows (id, vector) by all pairs, sorted."""
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, label = [0] * len(rows), list(range(len(rows)))
    for length in {len(v) for (_, v), f in zip(rows, fine) if f}:
        at = [i for i, f in enumerate(fine) if f and len(rows[i][1]) == length]
        x = hnsw.unit(np.array([rows[i][1] for i in at], float))
        for a, s in zip(at, x @ x.T >= least):
            near = [at[j] for j in np.flatnonzero(s) if at[j] != a]
            links[a] = len(near)
            for b in near:
                label = [label[a] if y == label[b] else y for y in label] if label[a] != label[b] else label
    low = {}
    for (i, _), y in zip(rows, label):
        low[y] = min([z for z in (low.get(y), i) if z is not None], default=None)
    out = [(i, n, low[y], i is not None and low[y] == i) for (i, _), n, y in zip(rows, links, label)]
    return sorted(out, key=str)


def turned(rng, v, cosine):
    away = rng.normal(size=len(v))
    away -= away @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


def planted(seed=1, many=1500, dims=24):
    rng = np.random.default_rng(seed)
    base = hnsw.unit(rng.normal(size=(many, dims)))
    more = [turned(rng, base[i], c) for i in range(many // 5) for c in (0.95, 0.91, 0.89)]
    group = [turned(rng, base[7], 0.97) for _ in range(150)]  # a large group of near copies
    x = np.concatenate([base, more, group, base[:40], 3 * base[40:60]])  # and exact and scaled ones
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]


def odd():
    ones = [1.0] * 24
    return [(90_000, None), (90_001, []), (90_002, [0.0] * 24), (90_003, [None, *ones[1:]]), (90_004, [float("nan"), *ones[1:]]), (90_005, [float("inf"), *ones[1:]]), (None, ones), (None, ones), (90_006, [1e300] * 24), (90_007, [1e-300] * 24), (90_008, [1.0, 2.0]), (90_009, [1.0, 2.0]), (90_008, [1.0, 2.0])]


def test_graph_reaches_all_rows_and_finds_the_nearest():
    rng = np.random.default_rng(0)
    x = hnsw.unit(np.concatenate([rng.normal(size=(3000, 16)), rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(800, 16))]))
    g = hnsw.Graph(x)
    assert len(g.sizes) > 1 and g.sizes[0] == len(x)
    q = hnsw.unit(rng.normal(size=(200, 16)))
    true = np.argsort(-(q.astype(np.float32) @ x.T.astype(np.float32)), axis=1)[:, :10]
    found, sims = g.search(q, 100)
    assert np.mean([len(set(a) & set(b[:10])) for a, b in zip(true, found)]) > 9.5
    assert np.allclose(sims[:, 0], np.einsum("ij,ij->i", q, x[found[:, 0]]), atol=1e-5)
    every, _ = g.search(q[:2], len(x))
    assert all(len(set(r)) == len(x) for r in every)
    assert hnsw.Graph(x[:1]).search(q[:1], 4)[0].tolist() == [[0]]


def test_beams_widen_until_the_audit_passes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 48))
    t = pa.table({"n": np.arange(len(x)), "copies": np.ones(len(x), np.int64), "vector": pa.array(x.tolist())})
    narrow, wide = (hnsw.Shard(t, 0.9, 1, recall, 256) for recall in (0.0, 1.0))
    assert narrow.ef == 1 < wide.ef
    probes = hnsw.unit(np.array([turned(rng, v, 0.901) for v in wide.x[:500]]))
    found = [sum(len(p) for _, p in s._near(probes, s.ef)) for s in (narrow, wide)]
    assert found[1] >= 495 and found[0] < found[1]


def test_rows_against_all_pairs(spark):
    rows = planted() + odd()
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    want = plain(rows)
    assert sum(r[1] > 0 for r in want) > 700
    for more in ({"shards": 1}, {"shards": 8, "shard_rows": 600}, {"shards": 5, "shard_rows": 500}):
        got = sorted((tuple(r) for r in hnsw.near_vectors(df, **more).collect()), key=str)
        assert len(got) == len(want)
        assert sum(a != b for a, b in zip(got, want)) == 0, more


def test_query_with_clashing_columns_and_empty_tables(spark, tmp_path):
    rows = planted(2, 120)[:200] + odd()
    spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, "x") for i, v in rows], COLS).write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    out = hnsw.op11_vector_near_dedup(spark, str(tmp_path / "a"))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(rows)
    spark.createDataFrame([], COLS).write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    assert hnsw.op11_vector_near_dedup(spark, str(tmp_path / "b")).count() == 0


def test_query_on_the_given_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in hnsw.op11_vector_near_dedup(spark, SF).collect()), key=str) == plain(rows)
