"""BM25 scored where chunks are read gives what the joins give, and moves neither texts nor scores."""

import random

from quarry.operators import lexical, prepare, retrieval

ROWS = "chunk_id string, ord long, part string, tokens array<string>"


def _tables(spark):
    dice = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    chunks = [(f"c{i}", i, "ab"[i % 2] if i % 17 else None, None if i % 29 == 3 else [w for w in words if dice.random() < 0.2] * dice.randint(1, 2)) for i in range(400)]
    chunks += [(f"same{i}", 1000 - i, "a", ["w1", "w2"]) for i in range(60)]
    queries = [(i, "ab"[i % 2], dice.sample([*words, "unknown"], 1 + i % 6)) for i in range(25)] + [(99, "b", []), (100, "a", ["nowhere"])]
    return spark.createDataFrame(chunks, ROWS).repartition(3), spark.createDataFrame(queries, "query_id long, part string, terms array<string>")


def _rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


def test_best_is_what_the_joins_rank(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WAITING", 50)
    monkeypatch.setattr(lexical, "CELLS", 100)
    chunks, queries = _tables(spark)
    for scope in (None, ["part"]):
        want = _rows(retrieval.ranked(retrieval.bm25(chunks, queries, scope), 7))
        words = retrieval.lexical(chunks, queries, scope)
        assert want and _rows(words.best(7)) == want
        assert _rows(words.best(3)) == [r for r in want if r[1] <= 3]
        joined = retrieval.lexical(chunks, queries, scope, most=1)
        assert isinstance(joined, retrieval.Joined) and _rows(joined.best(7)) == want


def test_scores_of_named_pairs(spark):
    chunks, queries = _tables(spark)
    for scope in (None, ["part"]):
        every = {(r.query_id, r.chunk_id): round(r.score, 9) for r in retrieval.bm25(chunks, queries, scope).collect()}
        pairs = queries.select("query_id").crossJoin(chunks.where("ord % 5 = 0").select("chunk_id"))
        got = {(r.query_id, r.chunk_id): round(r.score, 9) for r in retrieval.lexical(chunks, queries, scope).of(pairs).collect()}
        assert got == {k: every[k] for k in got}
        assert {k for k in every if k[1].startswith("c") and int(k[1][1:]) % 5 == 0} <= set(got)


def test_search_never_scores_all_pairs(spark, monkeypatch):
    """The joins' scores of every chunk that holds a term grew with questions times chunks."""
    monkeypatch.setattr(retrieval, "bm25", lambda *_: 1 / 0)
    chunks, queries = _tables(spark)
    assert retrieval.search(chunks, queries, "keyword", 3).count() > 0


def test_windows_of_a_source_are_not_moved(spark):
    docs = [("a", "x" * 320 + " " + "y" * 900, 1), ("b", "z" * 1500, 2), ("b", "z" * 700, 3)]
    table = spark.createDataFrame(docs, "source_id string, text string, n int")
    one = prepare.chunks(table.where("source_id = 'a'"))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    got = [(r.source_id, r.char_start, r.content_sha256) for r in prepare.chunks(table).collect()]
    assert len({(s, h) for s, _, h in got}) == len(got)  # a text stands once in a source, of one row or two
    repeated = spark.createDataFrame([("r", "q" * 2000, 1)], "source_id string, text string, n int")
    assert sorted(r.char_start for r in prepare.chunks(repeated).collect())[0] == 0
    assert {r.char_start for r in prepare.chunks(repeated).collect()} == {0, 1960}
