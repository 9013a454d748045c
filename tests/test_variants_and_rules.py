"""Tests of variants, of a reranking model's batches, of closed schemas, and of what guards an evaluation."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.schema import broken
from quarry.operators import evaluation, index, model_scorer, prepare, review, variants
from quarry.plans import indexed

SOURCES = "source_id string, text string"


def written(spark, path, chunks, sources, model="m"):
    index.write(str(path), chunks, sources, prepare.manifest(chunks.select("chunk_id"), {"model_id": model, "dimension": 2, "query_prefix": ""}), span=10)
    return index.read(spark, str(path))


@pytest.fixture
def chunks(spark):
    rows = [(f"c{i}", f"s{i}", i, f"alpha beta gamma{i}", ["alpha", "beta", f"gamma{i}"], "reviewed", [1.0, float(i)]) for i in range(12)]
    return spark.createDataFrame(rows, "chunk_id string, source_id string, ord long, text string, tokens array<string>, review_status string, vector array<double>")


def test_differences_do_not_depend_on_order_and_name_what_differs(spark):
    rows = [(f"s{i}", f"text {i}") for i in range(300)] + [("s1", "text 1"), (None, "x")]
    a = spark.createDataFrame(rows, SOURCES)
    assert variants.differences(a, spark.createDataFrame(rows[::-1], SOURCES).repartition(7), buckets=16).count() == 0
    b = spark.createDataFrame([r for r in rows if r[0] != "s9"][:-2] + [("s5", "text 5"), ("new", "x"), (None, "y")], SOURCES).withColumn("text", F.when(F.col("source_id") == "s7", None).otherwise(F.col("text")))
    got = {(r.source_id, r.kind) for r in variants.differences(a, b, buckets=16).collect()}
    assert got == {("s9", "missing"), ("new", "extra"), ("s5", "changed"), ("s7", "changed"), ("s1", "changed"), (None, "changed")}


def test_only_variants_of_the_same_sources_and_model_are_compared(spark, tmp_path, chunks):
    sources = chunks.select("source_id", "text")
    base = written(spark, tmp_path / "a", chunks, sources)
    short = written(spark, tmp_path / "b", chunks.withColumn("tokens", F.slice("tokens", 3, 1)), sources)
    cases = spark.createDataFrame([(1, "gamma3?", ["s3"], ["gamma3"], [0.0, 1.0], None), (2, "alpha?", ["s5"], ["alpha"], None, None), (3, "no", [], ["nothing"], None, None), (4, "gamma1?", ["s1"], ["gamma1"], None, "refused")], "query_id long, query string, relevant array<string>, terms array<string>, vector array<double>, reason string")
    rows = {(r.variant, r.query_id): r for r in variants.compare({"base": base, "short": short}, {"d": cases}, "keyword").collect()}
    assert rows["base", 1].candidates == rows["short", 1].candidates == rows["base", 1].evidence == ["s3"]
    assert rows["base", 2].candidates == [f"s{i}" for i in range(5)] and rows["short", 2].candidates == []
    assert rows["base", 3].candidates == rows["base", 4].candidates == [] and all(r.elapsed_ms > 0 for r in rows.values())
    other = written(spark, tmp_path / "c", chunks, sources.withColumn("text", F.when(F.col("source_id") == "s4", "z").otherwise(F.col("text"))))
    with pytest.raises(ValueError, match="variant other: source s4 is changed"):
        variants.compare({"base": base, "other": other}, {"d": cases})
    with pytest.raises(ValueError, match="another model"):
        variants.require_comparable({"base": base, "x": written(spark, tmp_path / "d", chunks, sources, "n")})


class Counted:
    """A model that tells how often it was loaded and how large its batches were."""

    def __init__(self, path):
        self.path = path
        with open(f"{path}/loads", "a") as f:
            f.write("x\n")

    def count(self, queries, passages):
        return [len(q.split()) + len(p.split()) for q, p in zip(queries, passages)]

    def score(self, queries, passages):
        sizes = [len(p.split()) for p in passages]
        with open(f"{self.path}/batches", "a") as f:
            f.write(f"{len(sizes)} {max(sizes)} {min(sizes)}\n")
        return [float(s) for s in sizes]


def test_a_model_is_loaded_once_a_worker_and_fed_like_lengths(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(i, "two words", " ".join(["w"] * (i % 50 + 1))) for i in range(200)], "i int, q string, p string").repartition(8)
    scorer = lambda name, limit: model_scorer.model_scorer(name, lambda: Counted(path), F.col("q"), F.col("p"), batch=16, limit=limit)
    for _ in range(2):
        got = {r.i: r.s for r in rows.select("i", scorer(f"m{path}", 512).alias("s")).collect()}
        assert got == {i: i % 50 + 1.0 for i in range(200)}
    assert len((tmp_path / "loads").read_text().split()) <= 4  # workers of local[4], not tasks or batches
    sizes = [list(map(int, x.split())) for x in (tmp_path / "batches").read_text().splitlines()]
    assert max(s[0] for s in sizes) == 16 and any(s[1] > s[2] for s in sizes)
    with pytest.raises(Exception, match="tokens together, over 20"):
        rows.select(scorer(f"n{path}", 20)).collect()
    with pytest.raises(Exception, match="is null"):
        spark.createDataFrame([(1, None, "p")], "i int, q string, p string").select(scorer(f"m{path}", 512)).collect()
    assert list(model_scorer.batches([3, 9, 1, 9, 5], 2)) == [[1, 3], [4, 0], [2]]


def test_schemas_name_the_path_of_what_breaks_them(spark):
    schema = {"type": "object", "required": ["a", "z"], "additionalProperties": False, "properties": {"a": {"type": "string", "enum": ["x", "y"]}, "n": {"type": "number", "minimum": 0}, "l": {"type": "array", "maxItems": 2, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}, "t": {"type": ["string", "null"], "pattern": "^t"}}}}, "w": {"type": "integer"}}}
    kind = "r struct<a:string,n:double,l:array<struct<k:int,t:string>>,w:string,more:int>"
    rows = [(("x", 1.0, [(1, "t"), (2, None)], None, None),), (("q", -1.0, [(None, "u"), None, (3, "t")], "5", 7),), ((None, float("nan"), [], None, None),), (None,)]
    df = spark.createDataFrame(rows, kind)
    got = [r[0] for r in df.select(broken(schema, F.col("r"), df.schema["r"].dataType)).collect()]
    assert got[0] == ["$: lacks z"] and got[3] == []
    assert set(got[1]) == {"$: lacks z", "$: more is not in the schema", "$.a: is none of the allowed values", "$.n: is too small", "$.l: has too many items", "$.l[0]: lacks k", "$.l[0].t: does not match", "$.l[1]: is null", "$.w: is no integer"}
    assert set(got[2]) == {"$: lacks a", "$: lacks z", "$.n: is no finite number"}
    with pytest.raises(ValueError, match="not known"):
        broken({"oneOf": []}, F.col("r"), df.schema["r"].dataType)


def test_guards_of_evaluations(spark):
    cases = spark.createDataFrame([], "query_id long, query string, category string, relevant array<string>, expect_evidence boolean")
    sources = spark.createDataFrame([("s",)], "source_id string")
    assert [r.rule for r in evaluation.case_violations(cases, sources).collect()] == ["no_cases"]
    some = spark.createDataFrame([(1, "q", " ", ["s"], True), (2, " ", "c", ["s"], True)], cases.schema)
    assert [(r.query_id, r.rule) for r in evaluation.case_violations(some, sources).collect()] == [(2, "query")]
    rows = [(m, d, 3, 1) for m in ("hybrid", "rerank") for d in ("a", "b")]
    summaries = spark.createDataFrame(rows, "mode string, dataset string, positive_cases long, negative_cases long")
    reports = spark.createDataFrame([("a", "x", "r1"), ("b", "x", "r1")], "dataset string, corpus_sha256 string, ranking string")
    assert evaluation.reranker_problems(summaries, reports, {"a": (3, 1), "b": (3, 1)}).count() == 0
    wrong = spark.createDataFrame([("a", "x", "r1"), ("b", "y", "r2")], reports.schema)
    got = {(r.dataset, r.problem) for r in evaluation.reranker_problems(summaries.where("mode != 'rerank' or dataset != 'a'"), wrong, {"a": (3, 1), "b": (3, 2)}).collect()}
    assert got == {("a", "denominator"), ("b", "denominator"), ("b", "corpus"), ("b", "ranking")}


def test_a_version_question_is_refused_by_its_own_scope(spark):
    chunks = spark.createDataFrame([("i0", "original_oj"), ("i1", "consolidated")], "instrument_id string, document_version string")
    asked = [(1, "is it current?", "i0"), (2, "is it current?", "i1"), (3, "is it current?", None), (4, "what is it?", "i0")]
    got = review.with_reasons(chunks, spark.createDataFrame(asked, "query_id long, query string, instrument string"))
    assert {r.query_id: r.reason for r in got.collect()} == {1: "version_review_required", 2: None, 3: "version_review_required", 4: None}
    with pytest.raises(ValueError, match="tokens_of"):
        review.research(chunks, chunks, got, scorer=F.lit(1.0))


def test_stand_in_model_counts_shared_words():
    assert indexed.SharedWords().score(["alpha beta, the rule"], ["Beta and ALPHA the rules"]) == [0]
