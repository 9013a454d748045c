"""Queries that read a persisted index or a corpus table, with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.dates import is_iso
from ..functions.schema import CHUNK, RESULT, broken
from ..operators import evaluation, index, prepare, retrieval, review, variants
from ..operators.model_scorer import model_scorer
from ..operators.shared import met, scratch, settle
from ..sources.corpus import Corpus
from . import catalogue, views
from .catalogue import _CTX, _QRELS, DOCS, GATE, ORACLE, QS, _bm25, _r, _tokens, query
from .views import table


# ------------------------------------------------------------------ index
@query(ORACLE["bm25_topk"])
def index_bm25_topk(spark, d):
    """bm25_topk from the index: only the asked terms' posting lists are read, of the stretches that can matter."""
    got = index.bm25(views.indexed(spark, d), views.questions(spark, d), 10)
    return got.select("query_id", F.col("ord").alias("doc_id"), _r("score"), F.col("rank").cast("long").alias("rank"))


@query(ORACLE["search_hybrid"])
def index_search_hybrid(spark, d):
    got = index.search(views.indexed(spark, d), views.questions(spark, d), "hybrid", 12, model=views.MODEL)
    return got.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), _r("rrf_score", 9), _r("keyword_score"), _r("cosine_similarity"))


@query(ORACLE["search_scoped"])
def index_search_scoped(spark, d):
    """Each question within its instrument and region: a chunk stands once in the index, whatever scopes it lies in."""
    got = index.search(views.indexed(spark, d), catalogue._scoped_cases(spark, d), "hybrid", 3)
    return got.select(F.lit("hybrid").alias("mode"), "query_id", F.col("chunk_id").alias("source_id"), F.col("rank").cast("long").alias("rank"), _r("keyword_score"), _r("cosine_similarity"))


@query(f"WITH {DOCS}, p AS (SELECT doc_id, len(tokens) AS l, term, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM docs) GROUP BY ALL) SELECT term, doc_id // 4096 AS stretch, count(*) AS n, max(tf)::BIGINT AS max_tf, min(l)::BIGINT AS min_len FROM p GROUP BY ALL")
def index_block_statistics(spark, d):
    """What the index knows of each term and stretch of 4,096 places without its lists."""
    return views.indexed(spark, d).postings.select("term", "stretch", "n", "max_tf", "min_len")


# ------------------------------------------------------------------ corpus table
def _corpus(spark, d) -> Corpus:
    """Two corpora and models of the documents; then a second commit, with new titles for every fifth, to one of them."""
    s = views.sources(spark, d).select(F.lit("c1").alias("corpus_id"), F.lit("m/1").alias("model_id"), F.col("source_id").alias("chunk_id"), "source_id", "instrument_id", "source_title", F.sha2("text", 256).alias("content_sha256"), "doc_id")
    s = settle(s)
    both = s.unionByName(s.where("doc_id % 2 = 0").withColumn("corpus_id", F.lit("c2")))
    first = Corpus(spark, scratch(spark, "corpus"), buckets=8).upsert(both.drop("doc_id"))
    return first.upsert(s.where("doc_id % 5 = 0").withColumn("source_title", F.concat(F.lit("new "), "source_title")).drop("doc_id"))


@query("SELECT 'doc-' || doc_id AS chunk_id, source AS instrument_id, CASE WHEN doc_id % 5 = 0 THEN 'new ' ELSE '' END || source || ' document ' || doc_id AS source_title FROM documents WHERE source IN (SELECT min(source) FROM documents)")
def corpus_scan(spark, d):
    """One instrument of one corpus and model, after two commits."""
    one = table(spark, d, "documents").agg(F.min("source")).first()[0]
    return _corpus(spark, d).scan("c1", "m/1", one or "none").select("chunk_id", "instrument_id", "source_title")


@query("SELECT 'doc-' || doc_id AS source_id, source || ' document ' || doc_id AS source_title, sha256(text) AS content_sha256 FROM documents WHERE doc_id IN (SELECT item_id * 2 FROM benchmark)")
def source_lookup(spark, d):
    """The other corpus's sources whose number is twice an item's; most numbers have none."""
    ids = [f"doc-{r[0]}" for r in table(spark, d, "benchmark").select(F.col("item_id") * 2).collect()]  # as a caller names them
    return _corpus(spark, d).lookup("c2", "m/1", ids).select("source_id", "source_title", "content_sha256")


# ------------------------------------------------------------------ variants
@query("SELECT 'doc-' || doc_id AS source_id, CASE WHEN doc_id % 97 = 5 THEN 'changed' WHEN doc_id % 97 = 6 THEN 'missing' ELSE 'changed' END AS kind FROM documents WHERE doc_id % 97 IN (5, 6, 8) UNION ALL SELECT 'more-' || doc_id, 'extra' FROM documents WHERE doc_id % 97 = 7")
def snapshot_differences(spark, d):
    """Two snapshots of all sources: texts that differ, sources that are gone, new ones, and ones that stand twice."""
    s = views.sources(spark, d)
    n = F.col("doc_id") % 97
    other = s.withColumn("text", F.when(n == 5, F.concat("text", F.lit("."))).otherwise(F.col("text"))).where(n != 6)
    other = other.unionByName(s.where(n == 7).withColumn("source_id", F.concat(F.lit("more-"), "doc_id"))).unionByName(s.where(n == 8))
    return variants.differences(s.drop("doc_id"), other.drop("doc_id"))


_SET = "CASE c.query_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END"
_POLICY = "regexp_matches(query, '[\\x{4e00}-\\x{9fff}]') OR regexp_matches(query, '(?i)\\b(current|currently|latest|today|now|compliant|compliance verdict)\\b|can (we|i) (launch|legally)')"


def _variant_sql(name: str, of: str) -> str:
    """lists of one variant: bm25 over `of`, whose body is what the gate looks at."""
    gate = GATE.replace("list_distinct(tokens)", "list_distinct(body)")
    return f"""SELECT * FROM (WITH {_bm25(of)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM bm JOIN open USING (query_id)),
g AS (SELECT query_id, source_id, place, {gate} AS good FROM (SELECT r.query_id, place, r.score AS kw, NULL::DOUBLE AS cosine, o.source_id, o.review_status, o.body, qs.terms FROM r JOIN {of} o USING (doc_id) JOIN qs ON qs.query_id = r.query_id WHERE place <= 5)),
l AS (SELECT query_id, list(source_id ORDER BY place) AS candidates, list(source_id ORDER BY place) FILTER (good) AS evidence FROM g GROUP BY 1)
SELECT '{name}' AS variant, {_SET} AS dataset, c.query_id, relevant, coalesce(candidates, []) AS candidates, coalesce(evidence, []) AS evidence FROM cases c LEFT JOIN l ON l.query_id = c.query_id)"""


_VARIANTS = f"""WITH {DOCS}, {QS}, {_QRELS}, open AS (SELECT query_id FROM qs WHERE NOT ({_POLICY})),
{_CTX.replace("ctx AS (", "ctx0 AS (")}, whole AS MATERIALIZED (SELECT *, tokens AS body FROM docs), ctx AS MATERIALIZED (SELECT c.*, d.tokens AS body FROM ctx0 c JOIN docs d ON d.doc_id = c.doc_id),
lead0 AS (SELECT * REPLACE (array_to_string(regexp_extract_all(text, '\\s*\\S+')[1:80], '') AS text) FROM docs), lead AS MATERIALIZED (SELECT * REPLACE ({_tokens('text')} AS tokens), {_tokens('text')} AS body FROM lead0),
lists AS ({_variant_sql("whole", "whole")} UNION ALL {_variant_sql("context", "ctx")} UNION ALL {_variant_sql("lead", "lead")}),
pairs AS (
  SELECT variant, dataset, count(*) AS cases, count(*) FILTER (len(relevant) > 0) AS positive_cases, count(*) FILTER (len(relevant) > 0 AND list_contains(relevant, candidates[1])) AS target_top1,
    count(*) FILTER (len(relevant) > 0 AND list_has_any(candidates, relevant)) AS target_top5, count(*) FILTER (len(relevant) > 0 AND list_has_any(evidence, relevant)) AS target_evidence_hits,
    count(*) FILTER (len(relevant) = 0 AND len(evidence) > 0) AS false_evidence_cases,
    round(avg(coalesce(len(list_intersect(evidence, relevant)) / nullif(len(evidence), 0), 0)) FILTER (len(relevant) > 0), 6) AS mean_positive_source_precision
  FROM lists GROUP BY ALL)"""


def _variants(spark, d):
    """(variants, datasets): whole texts, texts behind title and language, and first 80 words, each an index of its own."""
    base = views.whole(spark, d)
    lead = fx.first_words(F.col("text"), F.lit(80))
    made = {
        "whole": base,
        "context": base.withColumn("tokens", fx.tokens(fx.retrieval_text(F.col("source_title"), F.col("language"), F.col("text")))),
        "lead": base.withColumn("text", lead).withColumn("tokens", fx.tokens(F.col("text"))),
    }
    out = {}
    for name, chunks in made.items():
        path = scratch(spark, f"index-{name}")
        index.write(path, chunks, views.sources(spark, d), lambda c: prepare.manifest(c.select("chunk_id", "text"), views.MODEL), vectors=views.vectors(spark, d))
        out[name] = index.read(spark, path)
    cases = catalogue._cases(spark, d).drop("jurisdiction").join(views.questions(spark, d).select("query_id", "terms", "vector"), "query_id")
    cases = settle(cases.withColumn("reason", review.query_policy(F.col("query"), F.lit(True))))
    return out, {"even": cases.where("query_id % 2 = 0"), "odd": cases.where("query_id % 2 = 1")}


_SUMMARY = ["cases", "positive_cases", "target_top1", "target_top5", "target_evidence_hits", "false_evidence_cases", "mean_positive_source_precision"]


@query(f"{_VARIANTS} SELECT * FROM pairs")
def variant_summary(spark, d):
    """Three variants of the index, built and asked the same cases in one job; latencies are left out, as they vary."""
    rows = variants.compare(*_variants(spark, d), mode="keyword")
    return evaluation.paired_summary(rows, ["variant", "dataset"]).select("variant", "dataset", *_SUMMARY)


@query(f"""{_VARIANTS}, j AS (SELECT a.*, b.false_evidence_cases AS bf, b.mean_positive_source_precision AS bm FROM pairs a JOIN pairs b ON a.dataset = b.dataset AND b.variant = 'whole' AND a.variant != 'whole')
SELECT variant, dataset || '_false_evidence' AS gate, false_evidence_cases <= bf AS passed FROM j UNION ALL SELECT variant, dataset || '_precision', coalesce(mean_positive_source_precision >= bm, false) FROM j
UNION ALL SELECT variant, 'canonical_target_hits', target_evidence_hits = 5 FROM j WHERE dataset = 'even' UNION ALL SELECT variant, 'paraphrase_target_hits', target_evidence_hits >= 1 FROM j WHERE dataset = 'odd'""")
def variant_gates(spark, d):
    """The adoption gates on variants that were really run; the gates on latency are left out, as it varies."""
    rows = evaluation.paired_summary(variants.compare(*_variants(spark, d), mode="keyword"), ["variant", "dataset"])
    gates = evaluation.indexing_adoption(rows, "whole", ("even", 5), ("odd", 1))
    return gates.where(~F.col("gate").endswith("_latency"))


# ------------------------------------------------------------------ a reranking model
class SharedWords:
    """Stands in for a model: how many different words of the question a passage has, less two."""

    @staticmethod
    def words(text: str) -> set:
        return {w for w in re.findall("[a-z0-9]+", text.lower()) if w not in fx.STOP}

    def count(self, queries, passages):
        return [len(q.split()) + len(p.split()) for q, p in zip(queries, passages)]

    def score(self, queries, passages):
        return [len(self.words(q) & self.words(p)) - 2 for q, p in zip(queries, passages)]


_HITS40 = catalogue._RERANKED.replace("len(tokens) % 7", "len(list_intersect(list_distinct(terms), list_distinct(tokens))) - 2").replace("ORDER BY rerank DESC, doc_id", "ORDER BY rerank DESC, source_id")


@query(f"{_HITS40} SELECT query_id, source_id, place, review_status != 'pending' AND rerank >= greatest(0, max(rerank) OVER (PARTITION BY query_id) - 2) AS kept FROM spread")
def rerank_model_review(spark, d):
    """Forty hits of the index scored by a model in batches of 16, longest pairs first, then ranked and gated by it."""
    q = settle(views.questions(spark, d))
    ix = views.indexed(spark, d)
    hits = met(settle(index.search(ix, q, "hybrid", 40)), ix.chunks.select("chunk_id", "source_id", "review_status", "text"), "chunk_id").join(q.select("query_id", "query"), "query_id")
    score = model_scorer("shared words", SharedWords, F.col("query"), F.col("text"), limit=1 << 20)
    rows = review.diverse(review.rerank(hits.drop("text", "query").withColumn("rerank_score", F.lit(0.0)).join(settle(hits.select("query_id", "chunk_id", score.alias("s"))), ["query_id", "chunk_id"]), F.col("s")))
    return rows.select("query_id", "source_id", F.col("place").cast("long").alias("place"), review.rerank_supported().alias("kept"))


# ------------------------------------------------------------------ rules as columns
@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN try_cast(day AS DATE) IS NOT NULL WHEN 1 THEN try_cast(day AS DATE) IS NOT NULL WHEN 2 THEN try_cast(day AS DATE) IS NOT NULL AND doc_id % 26 < 24 AND doc_id % 62 < 60 ELSE false END AS valid
FROM (SELECT doc_id, printf('%04d-%02d-%02d', 1990 + doc_id % 40, doc_id % 14, doc_id % 33) AS day FROM documents)""")
def iso_dates(spark, d):
    """Dates made of the documents' numbers, many of which there are not: with dashes, without, with a time, and in words."""
    n = F.col("doc_id")
    day = F.format_string("%04d-%02d-%02d", 1990 + n % 40, n % 14, n % 33)
    text = F.when(n % 4 == 0, day).when(n % 4 == 1, F.regexp_replace(day, "-", "")).when(n % 4 == 2, F.concat(day, F.format_string("T%02d:%02d:00.25+01:00", n % 26, n % 62))).otherwise(F.concat(F.lit("on "), day))
    return table(spark, d, "documents").select("doc_id", is_iso(text).alias("valid"))


@query("""SELECT doc_id, list_sort(list_filter([CASE WHEN doc_id % 9 = 1 THEN '$.query: is too short' END, CASE WHEN doc_id % 9 = 2 THEN '$.answer_status: is none of the allowed values' END,
  CASE WHEN doc_id % 9 = 3 THEN '$.evidence[1].content_sha256: does not match' END, CASE WHEN doc_id % 9 = 4 THEN '$.evidence[0]: lacks chunk_id' END, CASE WHEN doc_id % 9 = 5 THEN '$.evidence[1].char_start: is too small' END,
  CASE WHEN doc_id % 9 = 6 THEN '$: lacks confidence' END, CASE WHEN doc_id % 9 = 7 THEN '$: verdict is not in the schema' END, CASE WHEN length(text) = 0 THEN '$.evidence[0].text: is too short' END, CASE WHEN length(text) = 0 THEN '$.evidence[1].text: is too short' END], lambda x: x IS NOT NULL)) AS broken FROM documents""")
def result_schema_violations(spark, d):
    """Results that quote a document twice, of which most break one rule each, by doc_id."""
    n = F.col("doc_id") % 9
    s = views.sources(spark, d)

    def quoted(i: int):
        sha = F.sha2("text", 256)
        return F.struct("source_id", "source_title", "source_url", F.when((n != 4) | F.lit(i == 1), F.col("source_id")).alias("chunk_id"), "text", F.when((n == 3) & F.lit(i == 1), F.upper(F.concat(sha, F.lit("f")))).otherwise(sha).alias("content_sha256"), F.when((n == 5) & F.lit(i == 1), -1).otherwise(0).alias("char_start"))

    rows = s.select(
        "doc_id", F.struct(
            F.when(n == 1, "").otherwise(F.lit("what")).alias("query"), F.when(n == 2, "found").otherwise(F.lit("evidence_found")).alias("answer_status"), F.array(quoted(0), quoted(1)).alias("evidence"),
            F.array().cast("array<struct<source_id:string,source_title:string,source_url:string>>").alias("review_candidates"), F.when(n != 6, "unrated").alias("confidence"), F.when(n == 7, True).alias("verdict"),
        ).alias("r"),
    )
    return rows.select("doc_id", F.array_sort(broken(RESULT, F.col("r"), rows.schema["r"].dataType)).alias("broken"))


@query("""SELECT doc_id, list_filter([CASE WHEN length(text) > 1200 THEN '$.text: is too long' WHEN length(text) = 0 THEN '$.text: is too short' END], lambda x: x IS NOT NULL) AS broken FROM documents""")
def chunk_closed_schema(spark, d):
    """Whole documents as chunks of the closed schema."""
    s = views.sources(spark, d)
    rows = s.select("doc_id", F.struct(F.col("source_id").alias("chunk_id"), "source_id", "source_title", "source_url", "retrieved_at", "text", F.sha2("text", 256).alias("content_sha256"), F.lit(0).alias("char_start"), "review_status", "language", "celex").alias("c"))
    return rows.select("doc_id", broken(CHUNK, F.col("c"), rows.schema["c"].dataType).alias("broken"))
