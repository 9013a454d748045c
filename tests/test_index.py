"""Tests of the persisted index: the same scores as without it, fewer lists read, all or nothing."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import index, prepare, retrieval

MODEL = {"model_id": "m", "dimension": 3, "query_prefix": ""}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):
        text = rng.choices(words, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(0, 30))
        vector = [rng.random() for _ in range(3)] if i % 7 else None
        rows.append((f"c{i}", f"s{i}", i, text, vector, f"i{i % 3}" if i % 11 else None, rng.choice(["x", "y", "全国"]) if i % 13 else None))
    rows += [("rare", "rare", 900, ["seldom"] * 3 + ["w0"], [0.1, 0.2, 0.3], "i1", "x")]
    return spark.createDataFrame(rows, "chunk_id string, source_id string, ord long, tokens array<string>, vector array<double>, instrument_id string, jurisdiction string")


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(10)
    rows = [(i, rng.choices([f"w{j}" for j in range(40)], k=rng.randint(1, 6)), [rng.random() for _ in range(3)] if i % 5 else None, ["i0", "i1", "all", None][i % 4], ["x", None, "y"][i % 3]) for i in range(25)]
    rows += [(90, ["nothing"], [1.0, 0.0, 0.0], None, None), (91, [], [1.0, 0.0, 0.0], None, None), (92, ["seldom", "w0"], None, None, None)]
    return spark.createDataFrame(rows, "query_id long, terms array<string>, vector array<double>, instrument string, region string")


@pytest.fixture(scope="module")
def written(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    index.write(path, corpus, corpus.select("source_id"), prepare.manifest(corpus.select("chunk_id"), MODEL), buckets=8, span=20)
    return index.read(spark, path)


def rows(df):
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_runs_of_equal_tokens(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["a"],)], "t array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(index.counted(F.col("t"))).collect()] == [[("a", 1), ("b", 2)], [], [("a", 1)]]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_best_chunks_are_those_of_a_full_scan(written, corpus, questions, k):
    plain = retrieval.ranked(retrieval.bm25(corpus, questions), k).select("query_id", "ord", "score", "rank")
    free = questions.drop("instrument", "region")
    assert rows(index.bm25(written, free, k).select("query_id", "ord", "score", "rank")) == rows(plain)


@pytest.mark.parametrize("mode", ["keyword", "dense", "hybrid"])
def test_search_is_that_of_the_tables(written, corpus, questions, mode):
    cols = ["query_id", "chunk_id", "ord", "rank", "rrf_score", "keyword_score", "cosine_similarity", "retrieval_method"]
    free = questions.drop("instrument", "region")
    assert rows(index.search(written, free, mode, 6).select(*cols)) == rows(retrieval.search(corpus, free, mode, 6).select(*cols))
    some, asked = retrieval.scoped(corpus, questions)
    plain = retrieval.search(some, asked, mode, 6, scope=["scope"])
    assert rows(index.search(written, questions, mode, 6).select(*cols)) == rows(plain.select(*cols))


def test_only_asked_terms_and_promising_stretches_are_read(spark, written):
    asked = spark.createDataFrame([(1, ["seldom", "w0"])], "query_id long, terms array<string>")
    found = index.Lexical(written, asked)
    of = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    buckets = {r[0] for r in written.postings.where("term in ('seldom', 'w0')").select("bucket").distinct().collect()}
    files = of(found.postings)
    assert files and all(any(f"/bucket={b}/" in f for b in buckets) for f in files) and len(files) < len(of(written.postings))
    assert "PartitionFilters: [isnotnull(bucket" in (plan := found.postings._jdf.queryExecution().toString()) or "PartitionFilters: [bucket" in plan
    assert {r[0] for r in found.head.select("term").distinct().collect()} == {"seldom", "w0"}
    every = found.head.select("stretch").distinct().count()
    kept = found._promising(1).count()
    assert kept < every / 2  # one chunk holds the rare word three times; few stretches can come near it
    assert [r.ord for r in found.best(1).collect()] == [900]


def test_an_index_is_whole_or_not_there(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    bad = corpus.withColumn("vector", F.when(F.col("ord") == 3, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    manifest = prepare.manifest(corpus.select("chunk_id"), MODEL)
    with pytest.raises(Exception, match="bad vector"):
        index.write(path, bad, corpus.select("source_id"), manifest, dimension=3)
    with pytest.raises(ValueError, match="no whole index"):
        index.read(spark, path)
    index.write(path, corpus, corpus.select("source_id"), manifest)
    with pytest.raises(FileExistsError):
        index.write(path, corpus, corpus.select("source_id"), manifest)
    with pytest.raises(ValueError, match="differ"):
        index.search(index.read(spark, path), corpus.limit(0).selectExpr("ord as query_id", "tokens as terms", "vector"), model=MODEL | {"dimension": 4})
    with pytest.raises(ValueError, match="unknown instrument"):
        index.bm25(index.read(spark, path), spark.createDataFrame([(1, ["w0"], "nope")], "query_id long, terms array<string>, instrument string"), 3)


def test_build_chains_all_steps(spark, tmp_path):
    docs = [(f"d{i}", f"Title {i}", "https://a.b/c", "2026-01-01", f"word{i} " * 90 + "Tail of it.", "reviewed") for i in range(6)]
    cols = "source_id string, source_title string, source_url string, retrieved_at string, text string, review_status string"
    df = spark.createDataFrame(docs, cols)
    encoder = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0), F.lit(2.0))
    words = lambda c: F.size(F.split(c, " "))
    for context in ("none", "metadata"):
        path = str(tmp_path / context)
        index.build(df, path, MODEL, encoder, words, context=context, buckets=4)
        got = index.read(spark, path)
        chunks = got.chunks.orderBy("ord").collect()
        assert [c.ord for c in chunks] == list(range(len(chunks))) and [c.source_id for c in chunks] == sorted(c.source_id for c in chunks)
        assert all(abs(sum(x * x for x in c.vector) - 1) < 1e-9 for c in chunks) and got.sources.count() == 6
        m = got.manifest.first()
        assert (m.chunks, m.model_id, m.chunker, m.document_context) == (len(chunks), "m", "characters-320-overlap-40-v2", context)
        asked = spark.createDataFrame([(1, ["word3"]), (2, ["title"])], "query_id long, terms array<string>")
        best = index.bm25(got, asked, 3).join(got.chunks.select("ord", "source_id"), "ord").collect()
        assert {r.source_id for r in best if r.query_id == 1} == {"d3"} and any(r.query_id == 2 for r in best) == (context == "metadata")
    for wrong, told in ((df.withColumn("source_url", F.lit("x")), "source_url"), (df.limit(0), "no chunks")):
        with pytest.raises(Exception, match=told):
            index.build(wrong, str(tmp_path / told), MODEL, encoder, words)
    with pytest.raises(Exception, match="over 5 tokens"):
        index.build(df, str(tmp_path / "long"), MODEL, encoder, words, limit=5)
    assert not (tmp_path / "long").exists()


def test_best_of_lists_is_what_their_join_ranks(spark, tmp_path, monkeypatch):
    """Every posting met every question that asks for it in a shuffle; now a stretch's lists are scored in one task."""
    import random

    from quarry.operators import index, lexical

    monkeypatch.setattr(lexical, "WAITING", 50)
    dice, words = random.Random(3), [f"w{i}" for i in range(25)]
    rows = [(f"c{i}", i, "ab"[i % 2], "en" if i % 3 else "fr", [w for w in words if dice.random() < 0.3], None) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ord long, instrument_id string, jurisdiction string, tokens array<string>, vector array<double>")
    path = str(tmp_path / "ix")
    index.write(path, chunks, chunks.select("chunk_id"), spark.createDataFrame([("m",)], "model_id string"), buckets=4, span=32)
    ix = index.read(spark, path)
    asked = [(i, [None, "all", "a"][i % 3], [None, "en"][i % 2], dice.sample([*words, "unknown"], 1 + i % 5)) for i in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, instrument string, region string, terms array<string>")
    for q in (queries, queries.drop("instrument", "region")):
        want, got = (sorted((r.query_id, r.rank, r.ord, round(r.score, 9)) for r in index.Lexical(ix, q, most).best(4).collect()) for most in (1, 500_000))
        assert want and got == want
        monkeypatch.setattr(index.Lexical, "_scored", lambda *_: 1 / 0)
        assert index.Lexical(ix, q).best(4).count() == len(want)
        monkeypatch.undo()
