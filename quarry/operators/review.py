"""Evidence for ranked hits: query policy, exact spans, one hit a source, gates, quote budgets, candidates.

hits: query_id, source_id, rank and a chunk's columns; every step is keyed by query_id, so one job answers all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import first_words, strip, word_count
from . import retrieval
from .shared import met, sent, settle

ACCEPTED = ("reviewed", "fictional", "source_verified")
# Questions that ask for the law of today.
VERSION_QUESTION = r"(?i)\b(current|currently|latest|today|now|compliant|compliance verdict)\b|can (we|i) (launch|legally)"


def query_policy(query: Column, original_version: Column) -> Column:
    """Why a query is refused, or null: it is not in English, or asks an original version about the present."""
    asks_now = original_version & query.rlike(VERSION_QUESTION)
    return F.when(query.rlike("[\\x{4e00}-\\x{9fff}]"), "english_required").when(asks_now, "version_review_required")


def valid_query(query: Column) -> Column:
    return query.isNotNull() & (F.length(F.regexp_replace(query, "(?U)\\s+", "")) > 0) & (F.length(query) <= 1000)


def in_scope(chunks: DataFrame, instrument: str = "all") -> DataFrame:
    """Chunks of an instrument, chosen before any count is taken; an unknown one is an error."""
    if instrument == "all":
        return chunks
    some = chunks.where(F.col("instrument_id") == instrument)
    if some.limit(1).isEmpty():
        raise ValueError(f"unknown instrument {instrument}")
    return some


def verify_spans(hits: DataFrame, sources: DataFrame, old_windows: bool = False, window: int = 320, few: bool = False) -> DataFrame:
    """hits with char_end and span_ok: text and hash equal the source's text at char_start. No search is made.

    old_windows: indexes of an older kind give the start of the unstripped window; where the window of `window`
    characters there, once stripped, is the text, char_start moves to where the text begins. A hit whose source or
    start is not known is judged by its hash alone; a hit without a hash by its text. few: hits are of few sources, so
    their spans may go to where the texts are.
    """
    span = F.struct("source_id", F.col("char_start").cast("int").alias("at"), F.length("text").alias("size"))
    # a source's text stays where it is read: of each asked span only digests leave it
    asked = hits.where("char_start is not null").select(span.alias("s")).distinct().groupBy("s.source_id").agg(F.collect_list("s").alias("spans"))
    asked = sent(settle(asked), 20_000) if few else asked

    def seen(s: Column) -> Column:
        here = F.when(s["at"] >= 0, F.substring("text", s["at"] + 1, s["size"]))
        raw = F.when(s["at"] >= 0, F.substring("text", s["at"] + 1, F.lit(window)))
        lead = F.length(raw) - F.length(F.regexp_replace(raw, "(?U)^\\s+", ""))
        return F.struct(s["at"].alias("__at"), s["size"].alias("__size"), F.sha2(here, 256).alias("__here"), F.sha2(strip(raw), 256).alias("__raw"), lead.alias("__lead"), F.lit(True).alias("__seen"))

    found = sources.select("source_id", "text").join(asked, "source_id").select("source_id", F.explode(F.transform("spans", seen)).alias("f")).select("source_id", "f.*")
    at = hits.withColumn("__at", F.col("char_start").cast("int")).withColumn("__size", F.length("text")).join(found, ["source_id", "__at", "__size"], "left")
    placed = F.col("__seen").isNotNull()
    own = F.sha2("text", 256)
    here = F.coalesce(F.col("__here") == own, F.lit(False))
    moves = placed & F.lit(old_windows) & (F.col("char_start") >= 0) & ~here & F.coalesce(F.col("__raw") == own, F.lit(False))
    at = at.withColumn("char_start", F.when(moves, (F.col("char_start") + F.col("__lead")).cast("long")).otherwise(F.col("char_start")))
    same = ~placed | here | moves
    hashed = F.col("content_sha256").isNull() | (own == F.col("content_sha256"))
    out = at.withColumn("char_end", F.when(placed, F.col("char_start") + F.length("text"))).withColumn("span_ok", F.coalesce(same & hashed, F.lit(False)))
    return out.drop("__at", "__size", "__here", "__raw", "__lead", "__seen")


def require_spans(hits: DataFrame, sources: DataFrame, old_windows: bool = False, few: bool = False) -> DataFrame:
    checked = verify_spans(hits, sources, old_windows, few=few)
    return checked.where(F.when(F.col("span_ok"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such span: "), F.coalesce("chunk_id", F.lit("null")))))).drop("span_ok")


def diverse(hits: DataFrame, most: int = 5) -> DataFrame:
    """The first hit of each source, then the first `most` of a query."""
    first = F.row_number().over(W.partitionBy("query_id", "source_id").orderBy("rank"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("place", first).where("place = 1").withColumn("place", place).where(F.col("place") <= most)


def supported(hits: DataFrame, q_terms: str = "terms", h_terms: str = "tokens") -> Column:
    """The evidence gate of keyword and hybrid hits, by body text and not by title."""
    terms = F.array_distinct(q_terms)
    need = F.when(F.size(terms) >= 3, 2).otherwise(1)
    shared = F.size(F.array_intersect(terms, F.col(h_terms)))
    official = (shared >= need) & (F.col("cosine_similarity").isNull() | (F.col("cosine_similarity") >= 0.6))
    return F.col("review_status").isin(*ACCEPTED) & (F.col("keyword_score") > 0) & ((F.col("review_status") != "source_verified") | official)


def rerank_supported(least: float = 0.0, gap: float = 2.0) -> Column:
    """The gate of reranked hits: no more than gap under the best of the query, and not under least."""
    best = F.max("rerank_score").over(W.partitionBy("query_id"))
    return F.col("review_status").isin(*ACCEPTED) & (F.col("rerank_score") >= F.greatest(F.lit(least), best - gap))


def rerank(hits: DataFrame, scorer: Column, most: int = 40) -> DataFrame:
    """hits with rerank_score and rank by it, ties by chunk_id; scorer is any column, such as a model's pandas UDF.

    A query of more than `most` candidates, or a score that is no number, is an error.
    """
    n = F.count("*").over(W.partitionBy("query_id"))
    fine = F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf"))
    out = hits.withColumn("rerank_score", scorer.cast("double")).withColumn("n", n)
    out = out.where(F.when(fine & (F.col("n") <= most), F.lit(True)).otherwise(F.raise_error(F.lit("too many candidates or no finite score")))).drop("n")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")))


def quote(hits: DataFrame, budget: int = 80) -> DataFrame:
    """hits cut to a budget of words for each query and source: text, words, taken, truncated, content_sha256, excerpt_of."""
    before = F.coalesce(F.sum("words").over(W.partitionBy("query_id", "source_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = hits.withColumn("words", word_count(F.col("text")).cast("long")).withColumn("left", F.lit(budget) - before).where("left > 0")
    at = at.withColumn("taken", F.least("words", "left")).withColumn("truncated", F.col("words") > F.col("left"))
    excerpt = F.when(F.col("truncated"), first_words(F.col("text"), F.col("taken"))).otherwise(F.col("text"))
    of = F.when(F.col("truncated"), F.struct("chunk_id", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), F.sha2("text", 256).alias("content_sha256")))
    at = at.withColumn("excerpt_of", of).withColumn("text", excerpt).withColumn("content_sha256", F.sha2("text", 256)).withColumn("char_end", F.col("char_start") + F.length("text"))
    own = F.concat_ws(":", "source_id", F.lit("excerpt"), F.col("char_start").cast("string"), F.col("char_end").cast("string"), F.substring("content_sha256", 1, 12))
    return at.withColumn("chunk_id", F.when(F.col("truncated"), own).otherwise(F.col("chunk_id"))).drop("left")


def review_candidates(distinct: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct hits of sources that gave no evidence but deserve a look."""
    pending = (F.col("keyword_score") > 0) & (F.col("review_status") == "pending")
    near = (F.col("review_status") == "source_verified") & (F.coalesce("cosine_similarity", F.lit(0.0)) >= 0.55)
    return distinct.join(evidence.select("query_id", "source_id").distinct(), ["query_id", "source_id"], "left_anti").where(pending | near)


def context_windows(hits: DataFrame, sources: DataFrame, tokens_of, limit: int = 512, width: int = 1600, lead: int = 640, floor: int = 320, step: int = 200) -> DataFrame:
    """hits with the widest window of their source around them whose token count fits; text, char_start, char_end.

    tokens_of(query, title and passage) counts tokens as a column. Widths go down by step to the larger of floor
    and the hit's length; a hit that does not fit then is an error, and so is one that is empty, longer than width or
    not in its source at char_start. Windows that repeat keep their first hit. Hits without a source or a start stay
    as they are, with no matched_chunk_id.
    """
    hits = settle(hits)
    # only the texts of hits are moved to them
    full = sources.select("source_id", F.col("text").alias("full_text")).join(sent(hits.select("source_id").distinct()), "source_id", "left_semi")
    at = hits.join(full, "source_id", "left")
    loose = at.where("full_text is null or char_start is null").drop("full_text")
    at = at.where("full_text is not null and char_start is not null")
    sound = (F.length("text") > 0) & (F.length("text") <= width) & (F.col("char_start") >= 0) & (F.substring("full_text", F.col("char_start").cast("int") + 1, F.length("text")) == F.col("text"))
    at = at.where(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("hit does not lie in its source or fit a window: "), "chunk_id"))))
    least = F.greatest(F.lit(floor), F.length("text"))
    widths = F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil((F.lit(width) - F.col("least")) / step).cast("int")), lambda i: F.greatest(F.col("least"), F.lit(width) - i * step)))
    at = at.withColumn("least", least).withColumn("w", F.explode(widths))
    start = F.greatest(F.lit(0), F.col("char_start") - F.least(F.lit(lead), F.floor((F.col("w") - F.col("least")) / 2)))
    end = F.least(F.length("full_text"), start + F.col("w"))
    start = F.greatest(F.lit(0), end - F.col("w"))
    at = at.withColumn("w_end", end.cast("long")).withColumn("w_start", start.cast("long"))
    # the full text ends here: only passages go through the windows
    at = at.withColumn("passage", F.expr("substring(full_text, cast(w_start as int) + 1, cast(w_end - w_start as int))")).drop("full_text")
    fits = tokens_of(F.col("query"), F.concat("source_title", F.lit("\n"), "passage")) <= limit
    best = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy(F.when(F.col("fits"), 0).otherwise(1), F.desc("w")))
    at = at.withColumn("fits", fits).withColumn("n", best).where("n = 1")
    at = at.where(F.when(F.col("fits"), F.lit(True)).otherwise(F.raise_error(F.lit("query and passage are over the token limit"))))
    first = F.row_number().over(W.partitionBy("query_id", "source_id", "w_start", "w_end").orderBy("rank"))
    at = at.withColumn("n", first).where("n = 1").withColumn("matched_chunk_id", F.col("chunk_id")).withColumn("text", F.col("passage")).withColumn("content_sha256", F.sha2("passage", 256))
    at = at.withColumn("chunk_id", F.concat_ws(":", "source_id", F.lit("context"), "w_start", "w_end", F.substring("content_sha256", 1, 12)))
    at = at.withColumn("char_start", F.col("w_start")).withColumn("char_end", F.col("w_end")).drop("least", "w", "w_start", "w_end", "passage", "fits", "n")
    return at.unionByName(loose, allowMissingColumns=True)


# How a scope is named in a question to a reranker.
SCOPE_NAMES = {"gdpr": "the General Data Protection Regulation", "dsa": "the Digital Services Act", "dma": "the Digital Markets Act", "ai-act": "the AI Act", "all": "EU law"}


def scoped_query(query: Column, instrument: Column) -> Column:
    """The question with its scope said in words; an instrument without a name of its own is said as it is."""
    names = F.create_map(*[F.lit(x) for pair in SCOPE_NAMES.items() for x in pair])
    own = F.coalesce(instrument, F.lit("all"))
    return F.concat(F.lit("Under "), F.coalesce(names[own], own), F.lit(", "), query)


def confidence(hits: Column) -> Column:
    """A list of hits is never rated; an empty one has no confidence at all."""
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, "unrated").otherwise("none")


def with_reasons(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """queries with reason: query_policy() by whether the chunks of their instrument (all, if they name none) hold an
    original version."""
    if "document_version" not in chunks.columns:
        return queries.withColumn("reason", query_policy(F.col("query"), F.lit(False)))
    named = F.col("instrument_id") if "instrument_id" in chunks.columns else F.lit(None).cast("string")
    old = chunks.where("document_version = 'original_oj'").select(named.alias("__i")).distinct()
    old = settle(old.unionByName(old.select(F.lit("all").alias("__i"))).distinct().where("__i is not null").withColumn("__old", F.lit(True)))
    own = F.coalesce(F.col("instrument").cast("string"), F.lit("all")) if "instrument" in queries.columns else F.lit("all")
    at = queries.withColumn("__i", own).join(sent(old), "__i", "left")
    return at.withColumn("reason", query_policy(F.col("query"), F.col("__old").isNotNull())).select(*queries.columns, "reason")


def research(chunks: DataFrame, sources: DataFrame, queries: DataFrame, retriever=None, gate=None, scorer=None, tokens_of=None, chunker: str = "characters", old_windows: bool = False, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries with reason, reviewed hits): policy, scope, search, spans, reranking, one hit a source, evidence.

    queries: query_id, query, terms, vector, and instrument if they are scoped. Refused queries are not searched.
    retriever(chunks, queries, top_k) gives hits in place of hybrid search; gate(hits) is a condition in place of the
    evidence gate. With scorer (and tokens_of), hits are put in their context, scored by the column scorer and ranked
    and gated by it. Hits carry place, supported, and for supported ones the quote: budget 80 words, or 512 for
    paragraph chunks and reranked hits. A span that is not in its source fails the job. vectors: as in search().
    """
    if (scorer is None) != (tokens_of is None):
        raise ValueError("a scorer needs tokens_of, which counts the tokens of its pairs, and the other way around")
    asked = settle(with_reasons(chunks, queries))
    open_ones = asked.where("reason is null")
    top_k = 40 if scorer is not None else 12
    if retriever:
        got = retriever(chunks, open_ones, top_k)
    elif "instrument" in queries.columns:
        some, scoped_ones = retrieval.scoped(chunks, open_ones)
        near = None if vectors is None else retrieval.scoped(vectors, open_ones)[0]
        got = retrieval.search(some, scoped_ones, "hybrid", top_k, scope=["scope"], vectors=near)
    else:
        got = retrieval.search(chunks, open_ones, "hybrid", top_k, vectors=vectors)
    cols = [c for c in chunks.columns if c not in ("vector", "ord")]
    hits = met(settle(got.drop("ord")), chunks.select(*cols), "chunk_id").join(sent(asked.select("query_id", "query", "terms", *(["instrument"] if "instrument" in queries.columns else []))), "query_id")
    hits = settle(require_spans(settle(hits), sources, old_windows, few=True))
    if scorer is not None:
        named = hits.withColumn("query", scoped_query(F.col("query"), F.col("instrument") if "instrument" in hits.columns else F.lit("all")))
        hits = rerank(context_windows(named, sources, tokens_of), scorer)
    one = settle(diverse(hits))
    test = gate(one) if gate else rerank_supported() if scorer is not None else supported(one)
    one = one.withColumn("supported", test)
    evidence = quote(one.where("supported"), 512 if scorer is not None or chunker == "paragraphs" else 80)
    return asked, evidence.unionByName(one.where("not supported"), allowMissingColumns=True)


def review(queries: DataFrame, hits: DataFrame, budget: int = 80) -> DataFrame:
    """A row a query: status, reason, evidence and review candidates, in rank order.

    queries: query_id, query, terms, reason (of query_policy); hits: ranked, without those of refused queries.
    """
    distinct = diverse(hits.join(queries.select("query_id", "terms"), "query_id"))
    evidence = quote(distinct.where(supported(distinct)), budget)
    more = review_candidates(distinct, evidence)
    listed = lambda rows, name: rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias(name))
    none = F.array().cast("array<string>")
    out = queries.join(listed(evidence, "evidence"), "query_id", "left").join(listed(more, "review_candidates"), "query_id", "left")
    found = F.when(F.col("evidence").isNotNull(), "evidence_found").otherwise("insufficient_evidence")
    return out.select("query_id", "reason", found.alias("answer_status"), F.coalesce("evidence", none).alias("evidence"), F.coalesce("review_candidates", none).alias("review_candidates"))


def answers(asked: DataFrame, reviewed: DataFrame) -> DataFrame:
    """A row a query of research(): reason, answer_status, confidence, evidence and candidates as lists of their hits."""
    quoted = F.struct("place", "source_id", "source_title", "source_url", "retrieved_at", "chunk_id", "text", "char_start", "char_end", "content_sha256", "truncated")
    near = (F.col("review_status") == "source_verified") & (F.coalesce("cosine_similarity", F.lit(0.0)) >= 0.55)
    look = ~F.col("supported") & (((F.col("keyword_score") > 0) & (F.col("review_status") == "pending")) | near)
    lists = reviewed.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("supported"), quoted))).alias("evidence"),
        F.array_sort(F.collect_list(F.when(look, F.struct("place", "source_id", "source_title", "source_url")))).alias("review_candidates"),
    )
    out = asked.select("query_id", "query", "reason").join(lists, "query_id", "left")
    found = F.coalesce(F.size("evidence") > 0, F.lit(False))
    return out.withColumn("answer_status", F.when(found, "evidence_found").otherwise("insufficient_evidence")).withColumn("confidence", confidence(F.col("evidence")))


def markdown(reviews: DataFrame) -> DataFrame:
    """(query_id, markdown) of answers(): the question, each quote with where it stands, and what else to look at."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("not known"))

    def quoted(h: Column) -> Column:
        span = F.concat(F.lit("- span: ["), text(h["char_start"]), F.lit(", "), text(h["char_end"]), F.lit(")"))
        part = F.when(h["truncated"], "- cut to the quote budget: read the whole text")
        return F.concat_ws("\n", F.concat(F.lit("### "), text(h["source_title"])), F.lit(""), F.concat(F.lit("> "), F.regexp_replace(h["text"], "\n", "\n> ")), F.lit(""), F.concat(F.lit("- source: "), text(h["source_url"])), F.concat(F.lit("- retrieved: "), text(h["retrieved_at"])), F.concat(F.lit("- chunk: "), text(h["chunk_id"])), F.concat(F.lit("- sha256: "), text(h["content_sha256"])), span, part)

    other = lambda h: F.concat(F.lit("- "), text(h["source_title"]), F.lit(" <"), text(h["source_url"]), F.lit(">"))
    blocks = lambda c, f, gap: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), f), gap)
    lines = F.concat_ws("\n\n", F.concat(F.lit("# Review of: "), "query"), F.concat(F.lit("Status: "), "answer_status", F.coalesce(F.concat(F.lit(", refused: "), "reason"), F.lit(""))), F.lit("## Evidence"), F.nullif(blocks("evidence", quoted, "\n\n"), F.lit("")), F.lit("## Not evidence, to look at"), F.nullif(blocks("review_candidates", other, "\n"), F.lit("")))
    return reviews.select("query_id", lines.alias("markdown"))


def evidence_sentences(hits: DataFrame, budget: int = 80, most: int = 4) -> DataFrame:
    """(query_id, n, sentence): the plain retriever's sentences in rank order that share a term with the query.

    hits carry terms (the query's) and text, a few chunks for each query. A sentence that was given is not given
    again; each source has a budget of words, a cut sentence ends in a mark, and one that finds its source's budget
    used up may still be given for another source. The first `most` of a query stay.
    """
    from ..functions.text import compact, plain_tokens, sentences

    each = hits.select("query_id", "source_id", "rank", "terms", F.posexplode(sentences(F.col("text"))).alias("pos", "s")).withColumn("s", strip(F.col("s"))).where("s != ''")
    each = each.where(F.arrays_overlap("terms", plain_tokens(F.col("s"), query=True)))
    item = F.struct("rank", "pos", "source_id", "s", compact(F.col("s")).alias("flat"), word_count(F.col("s")).cast("long").alias("words"))
    lists = each.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    none = F.array().cast("array<struct<source_id:string,s:string,taken:bigint,sentence:string>>")

    def add(given: Column, x: Column) -> Column:
        used = F.aggregate(F.filter(given, lambda g: g["source_id"] == x["source_id"]), F.lit(0).cast("long"), lambda n, g: n + g["taken"])
        left = F.lit(budget) - used
        cut = F.concat(F.array_join(F.slice(F.split(x["flat"], " "), F.lit(1), F.greatest(left, F.lit(0)).cast("int")), " "), F.lit(" […]"))
        new = F.struct(x["source_id"].alias("source_id"), x["s"].alias("s"), F.least(x["words"], left).alias("taken"), F.when(x["words"] > left, cut).otherwise(x["flat"]).alias("sentence"))
        skip = (F.size(given) >= most) | F.exists(given, lambda g: g["s"] == x["s"]) | (left <= 0)
        return F.when(skip, given).otherwise(F.concat(given, F.array(new)))

    chosen = lists.select("query_id", F.posexplode(F.aggregate("all", none, add)).alias("i", "g"))
    return chosen.select("query_id", (F.col("i") + 1).alias("n"), "g.sentence")
