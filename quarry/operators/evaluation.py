"""Metrics of retrieval and evidence by case, by category and overall, and the gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import NATIONAL, lexical, scoped, search
from .review import supported
from .shared import met, sent, settle


def case_violations(cases: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """(query_id, rule) of cases that repeat an id or a label, lack an id, query or category, name unknown sources, or
    expect evidence without naming any; a list without cases breaks a rule of its own, with a null query_id.

    strict, for paired evaluation: labels and expected evidence must go together, and there must be cases of both
    kinds (a rule with a null query_id).
    """
    blank = lambda c: F.coalesce(F.length(F.regexp_replace(F.col(c).cast("string"), "(?U)\\s+", "")), F.lit(0)) == 0
    empty = lambda c: F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) == 0
    labels = F.coalesce(F.size("relevant"), F.lit(0))
    rules = {"id": empty("query_id"), "query": blank("query"), "category": empty("category"), "repeated_label": F.size(F.array_distinct("relevant")) < F.size("relevant"), "expects_without_label": F.col("expect_evidence") & (labels == 0), "expect_evidence": F.col("expect_evidence").isNull(), "labels": F.col("relevant").isNull()}
    if strict:
        rules["labels_without_expecting"] = ~F.col("expect_evidence") & (labels > 0)
    own = cases.select("query_id", F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))).alias("rule"))
    twice = cases.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("duplicate").alias("rule"))
    named = cases.select("query_id", F.explode("relevant").alias("source_id"))
    unknown = named.join(sources.select("source_id"), "source_id", "left_anti").select("query_id", F.lit("unknown_source").alias("rule")).distinct()
    nothing = cases.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(cases.schema["query_id"].dataType).alias("query_id"), F.lit("no_cases").alias("rule"))
    out = own.unionByName(twice).unionByName(unknown).unionByName(nothing)
    if strict:
        kinds = cases.agg(F.count(F.when(F.col("expect_evidence"), 1)).alias("yes"), F.count(F.when(~F.col("expect_evidence"), 1)).alias("no"))
        kind = cases.schema["query_id"].dataType
        out = out.unionByName(kinds.where("yes = 0 or no = 0").select(F.lit(None).cast(kind).alias("query_id"), F.lit("one_kind_only").alias("rule")))
    return out


def evaluate(chunks: DataFrame, cases: DataFrame, modes=("keyword", "dense", "hybrid"), top_k: int = 3, vectors: DataFrame | None = None, text: str | None = None) -> DataFrame:
    """case_metrics rows of each mode. cases carry terms, vector, instrument and region beside their labels, and are
    searched within their scope; evidence is what the gate lets through among their top_k. vectors and text: as in search()."""
    if not 1 <= top_k <= 20:
        raise ValueError("top_k lies between 1 and 20")
    some, asked = scoped(chunks, cases)
    asked = settle(asked)
    near = scoped(chunks if vectors is None else vectors, cases)[0]
    words = lexical(some, asked, ["scope"], text=text)
    if "hybrid" in modes:
        words.best(20)  # search()'s depth: the shallower rankings are part of it
    cols = chunks.select("chunk_id", "source_id", "review_status", "jurisdiction", text or "tokens")
    out = None
    for mode in modes:
        got = search(some, asked, mode, top_k, scope=["scope"], vectors=near, words=words)
        hits = met(got, cols, "chunk_id")
        # settled first, so that only texts of hits are cut into tokens
        hits = settle(hits).withColumn("tokens", tokens(F.col(text))).drop(text) if text else hits
        hits = settle(hits.join(sent(asked.select("query_id", "terms")), "query_id"))
        rows = case_metrics(cases.withColumn("jurisdiction", F.col("region")), hits, hits.where(supported(hits))).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def case_metrics(cases: DataFrame, hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row a case: recall, reciprocal rank, hit, source precision (null without labels), evidence policy, leaks.

    cases: query_id, category, relevant (array of source ids), expect_evidence, jurisdiction. Sources count once.
    """
    found = hits.join(cases.select("query_id", "relevant", F.col("jurisdiction").alias("region")), "query_id")
    good = F.array_contains("relevant", F.col("source_id"))
    leak = F.col("region").isNotNull() & ~F.coalesce(F.col("jurisdiction").isin(*NATIONAL) | (F.col("jurisdiction") == F.col("region")), F.lit(False))
    per = found.groupBy("query_id").agg(F.count_distinct(F.when(good, F.col("source_id"))).alias("right"), F.count_distinct("source_id").alias("found"), F.min(F.when(good, F.col("rank"))).alias("first"), F.count(F.when(leak, 1)).alias("leaks"))
    given = evidence.groupBy("query_id").agg(F.array_sort(F.collect_set("source_id")).alias("given"))
    at = cases.join(per, "query_id", "left").join(given, "query_id", "left")
    n, right = F.size("relevant"), F.coalesce("right", F.lit(0))
    labelled = lambda c: F.when(n > 0, c)
    emitted = F.col("given").isNotNull()
    return at.select(
        "query_id", "category", "expect_evidence",
        labelled(right / n).alias("recall_at_k"), labelled(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        labelled(F.col("first").isNotNull()).alias("hit_at_k"),
        labelled(F.coalesce(right / F.nullif(F.col("found"), F.lit(0)), F.lit(0.0))).alias("source_precision"),
        emitted.alias("emitted_evidence"), (emitted == F.col("expect_evidence")).alias("evidence_policy_passed"),
        F.array_except(F.coalesce("given", F.array().cast("array<string>")), "relevant").alias("unlabeled_sources"),
        F.coalesce("leaks", F.lit(0)).alias("jurisdiction_leaks"), "relevant",
    )


def mean(c: str) -> Column:
    return F.round(F.avg(F.col(c).cast("double")), 6)


def summary(rows: DataFrame) -> DataFrame:
    """(mode, category) and, with a null category, mode totals of case_metrics rows that carry mode and elapsed_ms.

    Null metrics are left out of means; an empty slice is null. p50 is the interpolated median, p95 the nearest rank.
    """
    negative = ~F.col("expect_evidence")
    wide = rows.groupingSets([["mode"], ["mode", "category"]], "mode", "category")
    return wide.agg(
        F.count("*").alias("cases"), F.count("recall_at_k").alias("labelled_cases"), F.count(F.when(negative, 1)).alias("no_evidence_cases"),
        mean("recall_at_k").alias("recall_at_k"), mean("reciprocal_rank").alias("mrr_at_k"), mean("hit_at_k").alias("hit_rate_at_k"),
        mean("source_precision").alias("mean_source_precision"), mean("evidence_policy_passed").alias("evidence_policy_accuracy"),
        F.round(F.avg(F.when(negative, F.col("emitted_evidence").cast("double"))), 6).alias("false_evidence_rate"),
        F.count(F.when(F.col("jurisdiction_leaks") > 0, 1)).alias("jurisdiction_leak_cases"),
        F.round(F.median("elapsed_ms"), 3).alias("latency_p50_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed_ms)").alias("latency_p95_ms"),
    )


def paired_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By mode, or by other columns: rows carry relevant, candidates, evidence (arrays of source ids) and elapsed_ms."""
    positive = F.size("relevant") > 0
    both = lambda a: F.size(F.array_intersect(F.col(a), F.col("relevant")))
    exact = F.coalesce(both("evidence") / F.nullif(F.size("evidence"), F.lit(0)), F.lit(0.0))
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY elapsed_ms)")
    count = lambda test: F.count(F.when(test, 1))
    return rows.groupBy(*(by or ["mode"])).agg(
        F.count("*").alias("cases"), count(positive).alias("positive_cases"), count(~positive).alias("negative_cases"),
        count(positive & F.array_contains("relevant", F.get("candidates", F.lit(0)))).alias("target_top1"), count(positive & (both("candidates") > 0)).alias("target_top5"),
        count(positive & (both("evidence") > 0)).alias("target_evidence_hits"), count(~positive & (F.size("evidence") > 0)).alias("false_evidence_cases"),
        F.round(F.avg(F.when(positive, exact)), 6).alias("mean_positive_source_precision"), rank(0.5).alias("latency_p50_ms"), rank(0.95).alias("latency_p95_ms"),
    )


def release_gate(totals: DataFrame, least_hit_rate: float | None = None, most_false_rate: float | None = None, mode: str = "hybrid") -> DataFrame:
    """(gate, observed, bound, passed) of a mode's totals; an unobserved value fails; no bounds, no rows."""
    for bound in (least_hit_rate, most_false_rate):
        if bound is not None and not 0 <= bound <= 1:
            raise ValueError("bounds lie between 0 and 1")
    one = totals.where((F.col("mode") == mode) & F.col("category").isNull())
    gates = []
    if least_hit_rate is not None:
        gates.append(("hit_rate_at_k", "hit_rate_at_k", least_hit_rate, F.col("hit_rate_at_k") >= least_hit_rate))
    if most_false_rate is not None:
        gates.append(("false_evidence_rate", "false_evidence_rate", most_false_rate, F.col("false_evidence_rate") <= most_false_rate))
    if gates:
        gates.append(("jurisdiction_leak_cases", "jurisdiction_leak_cases", 0.0, F.col("jurisdiction_leak_cases") == 0))
    checks = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(c).cast("double").alias("observed"), F.lit(float(b)).alias("bound"), F.coalesce(t, F.lit(False)).alias("passed")) for n, c, b, t in gates])
    return one.select(F.explode(checks).alias("g")).select("g.*") if gates else one.select(F.lit("").alias("gate"), F.lit(0.0).alias("observed"), F.lit(0.0).alias("bound"), F.lit(True).alias("passed")).limit(0)


def adoption(paired: DataFrame, baseline: str, slowdown: float = 4.0) -> DataFrame:
    """(mode, gate, passed): each other mode of paired_summary against the baseline's.

    No fewer target hits, no more false evidence, no less precision, and a median latency within slowdown times;
    modes must have seen the same cases. It advises, and changes no default.
    """
    base = paired.where(F.col("mode") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in paired.columns])
    at = paired.where(F.col("mode") != baseline).join(F.broadcast(base))  # one row
    c = F.col
    gates = {
        "same_cases": (c("positive_cases") == c("b_positive_cases")) & (c("negative_cases") == c("b_negative_cases")),
        "target_hits": c("target_evidence_hits") >= c("b_target_evidence_hits"),
        "false_evidence": c("false_evidence_cases") <= c("b_false_evidence_cases"),
        "precision": c("mean_positive_source_precision") >= c("b_mean_positive_source_precision"),
        "latency": c("latency_p50_ms") <= c("b_latency_p50_ms") * slowdown,
    }
    return at.select("mode", F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(t, F.lit(False)).alias("passed")) for n, t in gates.items()])).alias("g")).select("mode", "g.gate", "g.passed")


def variant_problems(rows: DataFrame, reported: DataFrame, baseline: str, datasets: dict[str, tuple[int, int]]) -> DataFrame:
    """(variant, dataset, problem): what keeps variants from being compared; no rows, if nothing does.

    rows: variant, dataset, query_id, query, relevant, candidates, evidence, elapsed_ms. reported: paired_summary()'s
    columns by variant and dataset, as a report states them. datasets: cases with and without labels of each.
    """
    by = ["variant", "dataset"]
    fine = (F.col("elapsed_ms") > 0) & (F.col("elapsed_ms") < float("inf"))
    one = rows.groupBy(*by).agg((F.count_distinct("query_id") != F.count("*")).alias("repeated"), F.count(F.when(~F.coalesce(fine, F.lit(False)), 1)).alias("bad_latency"))
    expected = F.create_map(*[x for name, (a, b) in datasets.items() for x in (F.lit(name), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    told = paired_summary(rows, by)
    at = told.join(one, by)
    shape = expected[F.col("dataset")]
    rules = {"repeated_case": F.col("repeated"), "latency": F.col("bad_latency") > 0, "denominator": F.coalesce((F.col("positive_cases") != shape["a"]) | (F.col("negative_cases") != shape["b"]), F.lit(True))}
    own = at.select(*by, F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))).alias("problem"))
    cols = sorted(told.columns)
    off = told.select(*cols).exceptAll(reported.select(*cols)).unionByName(reported.select(*cols).exceptAll(told.select(*cols)))
    labels = rows.select("variant", "dataset", "query_id", "query", F.array_sort("relevant").alias("relevant"))
    base = labels.where(F.col("variant") == baseline).drop("variant")
    names = rows.select("variant").distinct()
    each = sent(names).join(base)  # the baseline's labels, once for each of a few variants
    drift = labels.exceptAll(each.select(*labels.columns)).unionByName(each.select(*labels.columns).exceptAll(labels))
    wanted = names.join(rows.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string"))
    absent = wanted.join(rows.select(*by).distinct(), by, "left_anti")
    say = lambda df, name: df.select(*by, F.lit(name).alias("problem")).distinct()
    return own.unionByName(say(off, "reported_summary")).unionByName(say(drift, "labels")).unionByName(say(absent, "missing_dataset"))


def indexing_adoption(summaries: DataFrame, baseline: str, canonical: tuple[str, int], paraphrase: tuple[str, int], slowdown: float = 4.0) -> DataFrame:
    """(variant, gate, passed): each other variant of paired_summary() by variant and dataset against the baseline.

    canonical and paraphrase name a dataset and the target hits it must reach, exactly all or at least. In every
    dataset: no more false evidence, no less precision, a median latency within slowdown times. No default changes.
    """
    base = summaries.where(F.col("variant") == baseline).select("dataset", *[F.col(c).alias(f"b_{c}") for c in ("false_evidence_cases", "mean_positive_source_precision", "latency_p50_ms")])
    at = summaries.where(F.col("variant") != baseline).join(base, "dataset", "left")
    c = F.col
    gate = lambda name, test: F.struct(name.alias("gate"), F.coalesce(test, F.lit(False)).alias("passed"))
    named = lambda s: F.concat(c("dataset"), F.lit(s))
    each = [gate(named("_false_evidence"), c("false_evidence_cases") <= c("b_false_evidence_cases")), gate(named("_precision"), c("mean_positive_source_precision") >= c("b_mean_positive_source_precision")), gate(named("_latency"), c("latency_p50_ms") <= c("b_latency_p50_ms") * slowdown)]
    hits = F.when(c("dataset") == canonical[0], gate(F.lit("canonical_target_hits"), c("target_evidence_hits") == canonical[1])).when(c("dataset") == paraphrase[0], gate(F.lit("paraphrase_target_hits"), c("target_evidence_hits") >= paraphrase[1]))
    return at.select("variant", F.explode(F.array_compact(F.array(hits, *each))).alias("g")).select("variant", "g.gate", "g.passed")


def reranker_adoption(summaries: DataFrame, bounds: dict[str, tuple[int, int]], most_false: int = 2) -> DataFrame:
    """(gate, passed): paired_summary() by mode (hybrid, rerank) and dataset.

    bounds: for the datasets canonical, known and holdout, the least target hits and the most false evidence of
    reranked cases; in holdout the false evidence must also stay within most_false and hybrid's own.
    """
    wide = summaries.groupBy().pivot("dataset", sorted(bounds)).agg(
        F.max(F.when(F.col("mode") == "rerank", F.col("target_evidence_hits"))).alias("hits"), F.max(F.when(F.col("mode") == "rerank", F.col("false_evidence_cases"))).alias("false"), F.max(F.when(F.col("mode") == "hybrid", F.col("false_evidence_cases"))).alias("base"),
    )
    gates = {}
    for name, (hits, false) in bounds.items():
        gates[f"{name}_target_hits"] = F.col(f"{name}_hits") >= hits
        gates[f"{name}_false_evidence"] = F.col(f"{name}_false") <= (F.least(F.lit(most_false), F.col(f"{name}_base")) if name == "holdout" else F.lit(false))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(t, F.lit(False)).alias("passed")) for n, t in gates.items()])).alias("g")).select("g.*")


def reranker_problems(summaries: DataFrame, reports: DataFrame, shape: dict[str, tuple[int, int]]) -> DataFrame:
    """(dataset, problem): what keeps reranked and plain modes from being compared; no rows, if nothing does.

    summaries: paired_summary() by mode (hybrid, rerank) and dataset. reports: dataset, corpus_sha256, ranking (how the
    reranker was set, as text) of each report. shape: cases with and without labels of each dataset. All reports must
    be of one corpus and ranking, and each mode must have seen all cases.
    """
    spark = summaries.sparkSession
    wanted = spark.createDataFrame([(d, m, *shape[d]) for d in shape for m in ("hybrid", "rerank")], "dataset string, mode string, yes long, no long")
    at = wanted.join(summaries.select("dataset", "mode", "positive_cases", "negative_cases"), ["dataset", "mode"], "left")
    whole = F.coalesce((F.col("positive_cases") == F.col("yes")) & (F.col("negative_cases") == F.col("no")), F.lit(False))
    short = at.where(~whole).select("dataset", F.lit("denominator").alias("problem"))
    first = min(shape)
    base = reports.where(F.col("dataset") == first).select(F.col("corpus_sha256").alias("c"), F.col("ranking").alias("r"))
    each = spark.createDataFrame([(d,) for d in shape], "dataset string").join(reports, "dataset", "left").join(F.broadcast(base), how="left")  # one row
    other = lambda a, b, name: each.where(~F.coalesce(F.col(a) == F.col(b), F.lit(False))).select("dataset", F.lit(name).alias("problem"))
    return short.unionByName(other("corpus_sha256", "c", "corpus")).unionByName(other("ranking", "r", "ranking")).distinct()
