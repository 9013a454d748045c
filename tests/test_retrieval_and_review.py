import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation, retrieval, review


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", 0, ["x", "y", "y"], [1.0, 0.0]), ("b", 1, ["x"], [0.0, 1.0]), ("c", 2, [], [0.6, 0.8]), ("d", 3, ["x"], [0.0, 1.0])]
    return spark.createDataFrame(rows, "chunk_id string, ord long, tokens array<string>, vector array<double>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, ["y", "x", "x"], [1.0, 0.0]), (2, ["q"], [0.0, 1.0])], "query_id long, terms array<string>, vector array<double>")


def test_bm25_counts_empty_chunks_and_query_terms_once(chunks, queries):
    got = {r.chunk_id: r.score for r in retrieval.bm25(chunks, queries).where("query_id = 1").collect()}
    mean, n = 5 / 4, 4

    def part(tf, df, length):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))

    assert got == pytest.approx({"a": part(1, 3, 3) + part(2, 1, 3), "b": part(1, 3, 1), "d": part(1, 3, 1)})


def test_ties_go_to_the_earlier_chunk_and_hybrid_keeps_both_scores(chunks, queries):
    order = [r.chunk_id for r in retrieval.ranked(retrieval.bm25(chunks, queries)).where("query_id = 1").orderBy("rank").collect()]
    assert order == ["a", "b", "d"]
    rows = {r.chunk_id: r for r in retrieval.search(chunks, queries, "hybrid", 5).where("query_id = 1").collect()}
    assert rows["c"].keyword_score == 0 and rows["c"].cosine_similarity == pytest.approx(0.6)
    assert rows["a"].rrf_score == pytest.approx(2 / 61)
    assert retrieval.search(chunks, queries, "keyword").where("cosine_similarity is not null").count() == 0


def test_quote_budget_is_shared_by_a_source(spark):
    rows = [(1, "s", i, f"c{i}", "one two three four", 0) for i in (1, 2, 3)]
    got = review.quote(spark.createDataFrame(rows, "query_id int, source_id string, rank int, chunk_id string, text string, char_start long"), 5).orderBy("rank").collect()
    assert [(r.text, r.taken, r.truncated) for r in got] == [("one two three four", 4, False), ("one", 1, True)]
    assert got[1].chunk_id.startswith("s:excerpt:0:3:") and got[1].excerpt_of.char_end == 18


def test_gate_wants_two_terms_and_a_near_vector_of_official_text(spark):
    cols = "query_id int, review_status string, keyword_score double, cosine_similarity double, terms array<string>, tokens array<string>"
    t = ["a", "b", "c"]
    rows = [(1, "pending", 1.0, 0.9, t, t), (2, "reviewed", 0.0, 0.9, t, t), (3, "reviewed", 1.0, 0.0, t, []), (4, "source_verified", 1.0, 0.7, t, ["a", "b"]), (5, "source_verified", 1.0, 0.7, t, ["a"]), (6, "source_verified", 1.0, 0.5, t, t), (7, "source_verified", 1.0, None, ["a"], ["a"])]
    df = spark.createDataFrame(rows, cols)
    assert [r[0] for r in df.where(review.supported(df)).orderBy("query_id").collect()] == [3, 4, 7]


def test_refusals(spark):
    df = spark.createDataFrame([("what is law",), ("法",), ("Is it current?",), ("can we launch",)], "q string")
    assert [r[0] for r in df.select(review.query_policy(F.col("q"), F.lit(True))).collect()] == [None, "english_required", "version_review_required", "version_review_required"]


def test_spans_that_differ_are_told(spark):
    s = spark.createDataFrame([("s", "ab😀cd")], "source_id string, text string")
    hits = spark.createDataFrame([("s", 2, "😀c"), ("s", 1, "😀c"), ("t", 0, "x")], "source_id string, char_start long, text string").withColumn("content_sha256", F.sha2("text", 256)).withColumn("chunk_id", F.lit("c"))
    assert sorted((r.source_id, r.char_start, r.span_ok) for r in review.verify_spans(hits, s).collect()) == [("s", 1, False), ("s", 2, True), ("t", 0, True)]
    with pytest.raises(Exception, match="no such span"):
        review.require_spans(hits, s).collect()


def test_metrics_count_sources_once_and_are_null_without_labels(spark):
    cases = spark.createDataFrame([(1, "c", ["s", "t"], True, None), (2, "c", [], False, "fr")], "query_id long, category string, relevant array<string>, expect_evidence boolean, jurisdiction string")
    hits = spark.createDataFrame([(1, "s", 2, "en"), (1, "s", 3, "en"), (1, "u", 1, "en"), (2, "u", 1, "en")], "query_id long, source_id string, rank int, jurisdiction string")
    rows = {r.query_id: r for r in evaluation.case_metrics(cases, hits, hits.where("query_id = 1")).collect()}
    assert (rows[1].recall_at_k, rows[1].reciprocal_rank, rows[1].source_precision) == (0.5, 0.5, 0.5)
    assert rows[2].recall_at_k is None and rows[2].jurisdiction_leaks == 1 and not rows[2].emitted_evidence


def test_old_window_starts_are_repaired_and_nothing_else(spark):
    text = "a" * 280 + "\n\n    " + "b" * 100
    s = spark.createDataFrame([("s", text)], "source_id string, text string")
    hits = spark.createDataFrame([("s", 280, "b" * 100), ("s", 281, "b" * 99), ("s", -1, "a"), ("s", None, "z")], "source_id string, char_start long, text string").withColumn("content_sha256", F.sha2("text", 256)).withColumn("chunk_id", F.lit("c"))
    got = {r.text: (r.char_start, r.span_ok) for r in review.verify_spans(hits, s, old_windows=True).collect()}
    assert got == {"b" * 100: (286, True), "b" * 99: (281, False), "a": (-1, False), "z": (None, True)}
    assert not review.verify_spans(hits, s).where("char_start = 280").first().span_ok


def test_evidence_sentences_as_an_ordered_walk(spark):
    import random

    rng = random.Random(9)
    names = ["tax", "rule", "port", "ship", "zebra"]
    for trial in range(6):
        chunks = [(1, rng.choice("ab"), i, ". ".join(" ".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(5)) + ".", ["tax", "rule"]) for i in range(3)]
        df = spark.createDataFrame(chunks, "query_id int, source_id string, rank int, text string, terms array<string>")
        want, used = [], {}
        for _, source, _, text, terms in chunks:
            for one in __import__("re").split(r"(?<=[.!?])\s+", text):
                if len(want) == 4 or one in [w[0] for w in want] or not set(terms) & set(one.rstrip(".").split()) or used.get(source, 0) >= 6:
                    continue
                words, left = one.split(), 6 - used.get(source, 0)
                used[source] = used.get(source, 0) + min(left, len(words))
                want.append((one, " ".join(words[:left]) + (" […]" if len(words) > left else "")))
        got = [r.sentence for r in review.evidence_sentences(df, 6, 4).orderBy("n").collect()]
        assert got == [w[1] for w in want]


def test_context_keeps_hits_without_a_source_and_refuses_wrong_ones(spark):
    s = spark.createDataFrame([("s", "x" * 3000)], "source_id string, text string")
    cols = "query_id int, query string, source_id string, source_title string, rank int, chunk_id string, text string, char_start long, content_sha256 string"
    rows = [(1, "q", "s", "t", 1, "c1", "x" * 300, 1000, ""), (1, "q", "none", "t", 2, "c2", "lost", 0, ""), (1, "q", "s", "t", 3, "c3", "loose", None, "")]
    got = {r.matched_chunk_id or r.chunk_id: r for r in review.context_windows(spark.createDataFrame(rows, cols), s, lambda a, b: F.length(b) / 4).collect()}
    assert set(got) == {"c1", "c2", "c3"} and got["c2"].text == "lost" and len(got["c1"].text) == 1600 and got["c1"].char_start == 1000 - 640
    for bad in ((1, "q", "s", "t", 1, "c", "x" * 1601, 0, ""), (1, "q", "s", "t", 1, "c", "y", 0, "")):
        with pytest.raises(Exception, match="does not lie"):
            review.context_windows(spark.createDataFrame([bad], cols), s, lambda a, b: F.lit(1)).collect()


def test_scopes_are_chosen_before_counting(chunks, queries):
    some = chunks.withColumn("instrument_id", F.when(F.col("ord") < 2, "i").when(F.col("ord") == 2, "j")).withColumn("jurisdiction", F.when(F.col("chunk_id") == "b", "fr").otherwise("全国"))
    asked = queries.withColumn("instrument", F.when(F.col("query_id") == 1, "i")).withColumn("region", F.when(F.col("query_id") == 1, "de"))
    left, right = retrieval.scoped(some, asked)
    got = retrieval.search(left, right, "hybrid", 5, scope=["scope"]).collect()
    assert {r.chunk_id for r in got if r.query_id == 1} == {"a"} and {r.chunk_id for r in got if r.query_id == 2} == {"a", "b", "c", "d"}
    with pytest.raises(ValueError, match="unknown instrument"):
        retrieval.scoped(some, asked.withColumn("instrument", F.lit("k")))


def test_variants_are_compared_only_if_they_can_be(spark):
    cols = "variant string, dataset string, query_id int, query string, relevant array<string>, candidates array<string>, evidence array<string>, elapsed_ms double"
    rows = [(v, "d", i, "q", ["s"] if i else [], ["s"], ["s"] if i else [], 2.0) for v in ("base", "new") for i in (0, 1)]
    df = spark.createDataFrame(rows, cols)
    told = evaluation.paired_summary(df, ["variant", "dataset"])
    assert evaluation.variant_problems(df, told, "base", {"d": (1, 1)}).count() == 0
    bad = spark.createDataFrame([("new", "d", 1, "other", ["s"], ["s"], [], 0.0)] + rows[:2], cols)
    got = {(r.variant, r.problem) for r in evaluation.variant_problems(bad, told, "base", {"d": (1, 1), "e": (1, 0)}).collect()}
    assert {("new", "latency"), ("new", "denominator"), ("new", "reported_summary"), ("new", "labels"), ("new", "missing_dataset")} <= got
