"""A persisted index: chunks, sources, and postings by term with statistics by block, which a search reads in part.

A posting block holds the chunks of one term within one stretch of `span` places (ord). Its statistics bound what any
of its chunks can score, so a search for the k best reads the lists of only those stretches that can hold one of them.
A posting names its chunk's group, a number for an instrument and jurisdiction, so a chunk stands once for all scopes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, retrieval_text, tokens
from ..sources.writers import require_vectors
from . import prepare, retrieval
from .lexical import Best, Terms, Weights
from .retrieval import B, K1, KEYS, NATIONAL, fuse, ranked
from .shared import exists, let, numbered, publish, sent, settle

SCOPE = ("instrument_id", "jurisdiction")
PARTS = ("chunks", "sources", "postings", "frequencies", "groups", "manifest")
BLOCK = ("term", "stretch")
HEAD = [*BLOCK, "n", "max_tf", "min_len", "best"]
#: A posting as it is shuffled.
POSTING = np.dtype([("ord", "<i8"), ("tf", "<i4"), ("len", "<i8"), ("code", "<i4")])
#: The scope of queries that ask for nothing in particular.
WHOLE = "all|"


@dataclass
class Index:
    """An index as tables. buckets and span are those it was written with."""

    chunks: DataFrame
    sources: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    groups: DataFrame
    manifest: DataFrame
    buckets: int
    span: int
    #: (chunk_id, ord, vector, *SCOPE); the chunks themselves if they were written with their vectors
    vectors: DataFrame


def counted(words: Column) -> Column:
    """array<struct<term, tf>> of a row's tokens, without a shuffle: equal ones stand together once sorted."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, let(F.array_sort(words), runs)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def posting_blocks(chunks: DataFrame, buckets: int, span: int, most: int = 1 << 20) -> DataFrame:
    """(bucket, *BLOCK, n, max_tf, min_len, best, rows) of chunks (ord, code, tokens): rows are (ord, tf, len, code) by
    ord, span of them at most; best is (tf, len) of one with the highest tf.

    A task packs about `most` postings of the chunks that it reads into pieces of blocks, one for each term and stretch;
    pieces are shuffled once, by bucket, and those of a block joined there. No posting is a row, if chunks lie about in
    ord's order, as written ones do; others make more and shorter pieces.
    """

    def pieces(batches):
        held, n = [], 0
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = _counts(batch.slice(a, 1024), span)
                held.append(part)
                n += len(part.column("tf").flatten())
                if n >= most:
                    yield from _blocks(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield from _blocks(pa.Table.from_batches(held))

    def unpack(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            first = int(np.flatnonzero(_heads(t))[-1]) if len(t) else 0  # the last block may go on
            if first:
                yield _unpacked(t.slice(0, first))
            held = t.slice(first).to_batches()[0] if len(t) else None
        if held is not None:
            yield _unpacked(pa.Table.from_batches([held]))

    head = "term string, stretch long, n long, max_tf long, min_len long, best struct<tf:long,len:long>"
    blocks = chunks.select(F.col("ord").cast("long").alias("ord"), F.col("code").cast("int").alias("code"), "tokens").mapInArrow(pieces, "term string, stretch long, packed binary")
    near = F.floor(F.col("stretch") / 64)  # a term of very many chunks is written by several tasks
    dealt = blocks.withColumn("bucket", _bucket(buckets)).repartition("bucket", near).sortWithinPartitions("bucket", *BLOCK)
    return dealt.drop("bucket").mapInArrow(unpack, f"{head}, rows array<struct<ord:long,tf:long,len:long,code:int>>").select(_bucket(buckets), *HEAD, "rows")


def _counts(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    """A row a chunk with each of its terms once; chunks without tokens are in no block."""
    tokens = batch.column("tokens")
    words = tokens.flatten().dictionary_encode()
    row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(1, len(words.dictionary))
    key, tf = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    has, size = np.unique(key // n, return_counts=True)
    ends = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
    has = pa.array(has)
    ords = batch.column("ord").take(has)
    terms, tfs = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(key % n))), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))
    stretch = pa.array(ords.to_numpy(zero_copy_only=False) // span)
    return pa.RecordBatch.from_arrays([stretch, ords, batch.column("code").take(has), pc.list_value_length(tokens).cast(pa.int64()).take(has), terms, tfs], ["stretch", "ord", "code", "len", "terms", "tf"])


def _blocks(chunks: pa.Table, most: int = 1 << 20):
    """Pieces of blocks of some chunks; batches of about `most` postings."""
    chunks = chunks.take(pa.array(np.argsort(chunks["ord"].to_numpy(), kind="stable"))).combine_chunks()
    stretches, at = np.unique(chunks["stretch"].to_numpy(), return_inverse=True)
    lists = chunks["terms"].chunk(0)
    words = lists.flatten().dictionary_encode()
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    key = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(stretches) + at[row]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    rows = np.empty(len(key), POSTING)
    rows["tf"] = chunks["tf"].chunk(0).flatten().to_numpy(zero_copy_only=False)[order]
    for c in ("ord", "len", "code"):
        rows[c] = chunks[c].to_numpy()[row]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[first[1:], len(key)]
    cuts = np.searchsorted(first, np.arange(most, len(key), most))
    for a, b in zip([0, *cuts], [*cuts, len(first)]):
        if a < b:
            packed = pa.array([rows[i:k].tobytes() for i, k in zip(first[a:b], ends[a:b])], pa.binary())
            own = key[first[a:b]]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(own // len(stretches))), pa.array(stretches[own % len(stretches)]), packed], [*BLOCK, "packed"])


def _heads(pieces: pa.Table) -> np.ndarray:
    """Whether each piece, sorted by block, is the first of its block."""
    term = pieces["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    stretch = pieces["stretch"].to_numpy()
    return np.r_[True, (term[1:] != term[:-1]) | (stretch[1:] != stretch[:-1])]


def _unpacked(pieces: pa.Table) -> pa.RecordBatch:
    """Whole blocks of pieces sorted by block, with their statistics and lists."""
    packed = pieces["packed"].combine_chunks()
    p = np.frombuffer(b"".join(packed.to_pylist()), POSTING)
    heads = _heads(pieces)
    start = np.flatnonzero(heads)
    n = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64) // POSTING.itemsize
    if len(start) < len(n):
        p = p[np.lexsort((p["ord"], np.repeat(np.cumsum(heads), n)))]
        n = np.add.reduceat(n, start)
    first, tf, length = np.cumsum(n) - n, p["tf"].astype(np.int64), p["len"]
    most, shortest = np.maximum.reduceat(tf, first), np.minimum.reduceat(length, first)
    # of those with the highest tf the shortest
    best = np.minimum.reduceat(np.where(tf == np.repeat(most, n), length, np.iinfo(np.int64).max), first)
    cols = [pa.array(x) for x in (p["ord"].copy(), tf, length.copy(), p["code"].copy())]
    rows = pa.ListArray.from_arrays(pa.array(np.r_[first, len(p)], pa.int32()), pa.StructArray.from_arrays(cols, ["ord", "tf", "len", "code"]))
    top = pa.StructArray.from_arrays([pa.array(most), pa.array(best)], ["tf", "len"])
    names = [pieces[c].combine_chunks().take(pa.array(start)) for c in BLOCK]
    return pa.RecordBatch.from_arrays([*names, *(pa.array(x) for x in (n, most, shortest)), top, rows], [*HEAD, "rows"])


def _frequencies(batches):
    """How many chunks of each group a block holds, from the codes of its postings."""
    for batch in batches:
        lists = batch.column("codes")
        code = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        key, df = np.unique((pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64) << 32) | code, return_counts=True)
        at = pa.array(key >> 32)
        yield pa.RecordBatch.from_arrays([batch.column("bucket").take(at), batch.column("term").take(at), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(df.astype(np.int64))], ["bucket", "term", "code", "df"])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def write(path: str, chunks: DataFrame, sources: DataFrame, manifest, dimension: int | None = None, buckets: int = 64, span: int = 4096, vectors: DataFrame | None = None) -> None:
    """The index of chunks (chunk_id, ord, tokens, vector and more) under path, all of it or nothing.

    vectors: (chunk_id, ord, vector, *SCOPE) of the chunks that have one, if chunks have no column for it; so no text is
    shuffled to its vector.
    manifest is a row, or a function that makes it of the written chunks, so that these are not computed again.
    Everything is staged beside path and renamed once it is whole; an existing index fails the write. With dimension,
    a vector that is not of it fails the job; a chunk without a vector then fails too.
    """
    spark = chunks.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"there is an index in {path}")
    staged = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    put = lambda df, part: df.write.parquet(f"{staged}/{part}")
    kept = require_vectors(chunks, dimension) if dimension else chunks
    put(kept.withColumns({c: F.lit(None).cast("string") for c in SCOPE if c not in chunks.columns}), "chunks")
    kept = spark.read.parquet(f"{staged}/chunks")
    put(sources, "sources")
    if vectors is not None:
        put(vectors.select("chunk_id", "ord", "vector", *SCOPE), "vectors")
    groups = kept.groupBy(*SCOPE).agg(F.count("*").alias("n"), F.sum(F.size("tokens")).cast("long").alias("len"))
    put(groups.withColumn("code", F.row_number().over(W.orderBy(*SCOPE))), "groups")  # few: instruments by jurisdictions
    groups = spark.read.parquet(f"{staged}/groups").select(*SCOPE, "code")
    coded = kept.select("ord", "tokens", *SCOPE).alias("c").join(sent(groups).alias("g"), _same("c", "g", SCOPE)).select("c.ord", "c.tokens", "g.code")
    posting_blocks(coded, buckets, span).write.partitionBy("bucket").parquet(f"{staged}/postings")
    codes = spark.read.parquet(f"{staged}/postings").select("bucket", "term", F.col("rows.code").alias("codes"))
    counts = codes.mapInArrow(_frequencies, "bucket int, term string, code int, df long").repartition("bucket").groupBy("bucket", "term", "code").agg(F.sum("df").alias("df"))
    counts.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{staged}/frequencies")
    manifest = manifest(kept) if callable(manifest) else manifest
    put(manifest.select("*", F.lit(buckets).alias("buckets"), F.lit(span).alias("span")), "manifest")
    publish(spark, staged, path)


def read(spark: SparkSession, path: str) -> Index:
    """The index under path. One that lacks a part is an error: it was not written whole."""
    if not all(exists(spark, f"{path}/{part}/_SUCCESS") for part in PARTS):
        raise ValueError(f"there is no whole index in {path}")
    tables = {part: spark.read.parquet(f"{path}/{part}") for part in PARTS}
    m = tables["manifest"].select("buckets", "span").first()
    own = spark.read.parquet(f"{path}/vectors") if exists(spark, f"{path}/vectors/_SUCCESS") else tables["chunks"]
    return Index(**tables, buckets=m.buckets, span=m.span, vectors=own)


def build(docs: DataFrame, path: str, model: dict, encoder, tokens_of, chunker: str = "characters", context: str = "none", limit: int = 512, **layout) -> None:
    """The whole way from source documents to an index under path: validate, clean, cut, check, encode, write.

    model: model_id, dimension, query_prefix; encoder and tokens_of as encoded() takes them. context "metadata" puts
    title and section before a text that is encoded or counted. A source that breaks a rule, a chunk out of its schema,
    a text too long for the model, a bad vector and an empty corpus fail the job, and then nothing is under path.
    """
    if context not in ("none", "metadata"):
        raise ValueError(f"unknown context {context}")
    spark = docs.sparkSession
    chunks = settle(prepare.prepare(docs, chunker))
    if chunks.isEmpty():
        raise ValueError("there are no chunks to index")
    known = [c for c in chunks.columns if c in (*prepare.CHUNK_FIELDS, *prepare.CHUNK_EXTRA)]
    wrong = prepare.chunk_violations(chunks.select(*known)).where(F.size("broken") > 0).select("chunk_id", "broken").first()
    if wrong:
        raise ValueError(f"chunk {wrong.chunk_id}: {', '.join(wrong.broken)}")
    own = F.col("text") if context == "none" else retrieval_text(prepare.field(chunks, "source_title"), prepare.field(chunks, "section"), F.col("text"))
    ready = prepare.encoded(chunks, own, encoder, tokens_of, model["dimension"], limit).withColumn("tokens", tokens(own))
    sources = docs.withColumn("text", clean(F.col("text")))
    write(path, numbered(ready, ["source_id", "char_start"], "ord"), sources, lambda c: prepare.manifest(c, model, chunker, context), model["dimension"], **layout)


def _same(a: str, b: str, cols) -> Column:
    out = None
    for c in cols:
        test = F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        out = test if out is None else out & test
    return out


def _weight(tf: Column, length: Column) -> Column:
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / F.greatest(F.col("mean"), F.lit(1.0))))


class Lexical:
    """BM25 over the postings of an index for one set of queries: query_id, terms, and instrument and region if scoped.

    A scope is an instrument (null or `all`: any) and a region (null: any; else that jurisdiction and national ones);
    counts and mean lengths are those of the scope. An unknown instrument is an error.
    """

    def __init__(self, index: Index, queries: DataFrame, most: int = 500_000):
        """most: asked terms that go to every task; more are joined to the lists instead."""
        self.index, self.most = index, most
        self.scoped = bool({"instrument", "region"} & set(queries.columns))
        one = lambda c: F.col(c).cast("string") if c in queries.columns else F.lit(None).cast("string")
        named = queries.withColumn("__i", F.coalesce(one("instrument"), F.lit("all"))).withColumn("__r", F.coalesce(one("region"), F.lit("")))
        asked = named.select("query_id", F.concat_ws("|", "__i", "__r").alias("scope"), "__i", "__r", F.explode(F.array_distinct("terms")).alias("term"))
        asked = settle(asked.withColumn("bucket", _bucket(index.buckets)))
        self.held = self._groups(asked.select("scope", "__i", "__r").distinct())
        self.asked = asked.select("query_id", "scope", "term")
        terms = settle(asked.select("term", "bucket").distinct())
        hit = [r[0] for r in terms.select("bucket").distinct().collect()]  # at most index.buckets
        of = lambda df: df.where(F.col("bucket").isin(hit)).join(sent(terms.select("term")), "term", "left_semi")
        self.postings = of(index.postings)
        # statistics only: the lists are not read here
        self.head = settle(self.postings.select(*BLOCK, "n", "max_tf", "min_len", "best"))
        df = self.head.groupBy("term").agg(F.sum("n").alias("df")).withColumn("scope", F.lit(WHOLE))
        if self.scoped:
            some = of(index.frequencies).join(F.broadcast(self.held.where(F.col("scope") != WHOLE).select("scope", "code")), "code")
            df = df.unionByName(some.groupBy("scope", "term").agg(F.sum("df").alias("df")))
        size = self.held.groupBy("scope").agg(F.sum("n").alias("docs"), (F.sum("len") / F.sum("n")).alias("mean"))
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.known = settle(df.join(F.broadcast(size), "scope").select("scope", "term", idf.alias("idf"), "mean"))

    def _groups(self, scopes: DataFrame) -> DataFrame:
        """(scope, code, n, len): the groups of chunks that each scope holds, settled."""
        groups = self.index.groups
        scopes = settle(scopes)
        strange = scopes.where("__i != 'all'").join(groups.select(F.col("instrument_id").alias("__i")), "__i", "left_anti").first()
        if strange:
            raise ValueError(f"unknown instrument {strange['__i']}")
        own = (F.col("__i") == "all") | (F.col("__i") == F.col("instrument_id"))
        near = (F.col("__r") == "") | F.col("jurisdiction").isin(*NATIONAL) | (F.col("jurisdiction") == F.col("__r"))
        return settle(groups.join(F.broadcast(scopes), F.coalesce(own & near, F.lit(False))).select("scope", "code", "n", "len"))

    def _promising(self, k: int) -> DataFrame:
        """(query_id, stretch) that can hold one of a query's k best.

        Of each block one chunk's weight is known and all are bounded. The k-th highest of the known ones of any one
        term is a score that k chunks reach; a stretch whose bounds add up to less holds none of the best. A block's
        known chunk may be out of a scope, so scoped queries leave out no stretch of their terms.
        """
        at = self.head.join(sent(self.known), "term").select("scope", *BLOCK, _weight(F.col("max_tf"), F.col("min_len")).alias("most"), _weight(F.col("best.tf"), F.col("best.len")).alias("one"))
        nth = F.row_number().over(W.partitionBy("term").orderBy(F.desc("one")))
        reached = at.where(F.col("scope") == WHOLE).withColumn("nth", nth).where(F.col("nth") == k).select("scope", "term", "one")
        need = self.asked.join(reached, ["scope", "term"]).groupBy("query_id").agg((F.max("one") * (1 - 1e-9)).alias("need"))
        bound = at.join(sent(self.asked), ["scope", "term"]).groupBy("query_id", "stretch").agg(F.sum("most").alias("most"))
        return bound.join(need, "query_id", "left").where(F.col("need").isNull() | (F.col("most") >= F.col("need"))).select("query_id", "stretch")

    def _lists(self, wanted: DataFrame) -> DataFrame:
        """(*BLOCK, ord, tf, len, code) of the blocks that wanted (settled) names."""
        blocks = self.postings.select(*BLOCK, "rows").join(sent(wanted.select(*BLOCK).distinct()), list(BLOCK), "left_semi")
        return blocks.select(*BLOCK, F.explode("rows").alias("r")).select(*BLOCK, "r.*")

    def _scored(self, rows: DataFrame) -> DataFrame:
        """(query_id, ord, score) of rows (query_id, scope, term, ord, tf, len, code) within their scopes."""
        if self.scoped:
            rows = rows.join(F.broadcast(self.held.select("scope", "code")), ["scope", "code"], "left_semi")
        weighed = rows.join(sent(self.known), ["scope", "term"]).select("query_id", "ord", _weight(F.col("tf"), F.col("len")).alias("w"))
        return weighed.groupBy("query_id", "ord").agg(F.sum("w").alias("score"))

    def best(self, k: int) -> DataFrame:
        """(query_id, ord, score, rank): the k best chunks of each query, ties to the smaller ord."""
        wanted = settle(self.asked.join(sent(settle(self._promising(k))), "query_id"))
        if self.asked.count() > self.most:
            return ranked(self._scored(self._lists(wanted).join(sent(wanted), list(BLOCK))), k)
        return ranked(self._candidates(wanted, k), k)

    def _candidates(self, wanted: DataFrame, k: int) -> DataFrame:
        """(query_id, ord, score): the k best of each query in each task. The wanted lists of a stretch meet in one task;
        a query that does not want it may be given too low a score there, which is none of its k best either way."""
        spark, kind = wanted.sparkSession, self.asked.schema["query_id"].dataType
        schema = f"query_id {kind.simpleString()}, ord long, score double"
        rows = self.asked.join(sent(self.known), ["scope", "term"]).select("query_id", "scope", "term", "idf", "mean").toArrow()
        if not len(rows):
            return spark.createDataFrame([], schema)
        terms = Terms(rows.select(["scope", "term"]))
        weights = Weights(terms, rows, rows["query_id"].combine_chunks().unique())
        groups: dict[str, list] = {}
        for r in self.held.select("scope", "code").collect():  # few: instruments by jurisdictions, for each scope
            groups.setdefault(r.scope, []).append(r.code)
        inside = [np.array(groups.get(s.as_py(), []), np.int64) for s in terms.scopes]

        def score(best, parts):
            table = pa.Table.from_batches(parts)
            lists = table["rows"].combine_chunks()
            p = lists.flatten()
            ords, tf, length, group = (p.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ord", "tf", "len", "code"))
            code = pc.fill_null(pc.index_in(table["term"].combine_chunks(), value_set=terms.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = code[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)]
            names, first, row = np.unique(ords, return_index=True, return_inverse=True)
            order = np.lexsort((code, row))
            row, code, tf, length, group = row[order], code[order], tf[order], length[first], group[first]
            for s, codes in enumerate(inside):
                at = terms.places(s, code)
                own = (at >= 0) & np.isin(group, codes)[row]
                weights.score(best, s, np.unique(row[own]), length, row[own], at[own], tf[own], names, pa.array(names))

        def run(batches):
            best, held, stretch = Best(k, len(weights.questions)), [], None
            for batch in batches:
                at = batch.column("stretch").to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
                for a, b in zip([0, *cuts], [*cuts, len(at)]):
                    if a < b:
                        if held and at[a] != stretch:
                            score(best, held)
                            held = []
                        stretch = at[a]
                        held.append(batch.slice(a, b - a))
            if held:
                score(best, held)
            best.shrink()
            for q, _, ords, scores, _ in best.parts:
                yield pa.RecordBatch.from_arrays([weights.questions.take(pa.array(q)), pa.array(ords), pa.array(scores)], ["query_id", "ord", "score"])

        blocks = self.postings.select(*BLOCK, "rows").join(sent(wanted.select(*BLOCK).distinct()), list(BLOCK), "left_semi")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return blocks.repartition(n, "stretch").sortWithinPartitions("stretch").mapInArrow(run, schema)

    def of(self, pairs: DataFrame) -> DataFrame:
        """(query_id, ord, score) of the named pairs (query_id, ord) that hold a term of their query."""
        pairs = settle(pairs.select("query_id", "ord").distinct().withColumn("stretch", F.floor(F.col("ord") / self.index.span)))
        wanted = settle(self.asked.join(sent(pairs), "query_id").select("query_id", "scope", *BLOCK, "ord"))
        rows = self._lists(wanted).join(sent(pairs.select("ord").distinct()), "ord", "left_semi")
        return self._scored(rows.join(sent(wanted), [*BLOCK, "ord"]))


def bm25(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, ord, score, rank): the k best chunks of each query by BM25, as retrieval.bm25() scores them."""
    return Lexical(index, queries).best(k)


def search(index: Index, queries: DataFrame, mode: str = "hybrid", top_k: int = 5, depth: int = 20, model: dict | None = None) -> DataFrame:
    """What retrieval.search() gives, from an index: query_id, chunk_id, ord, rank, rrf_score, keyword_score, cosine_similarity,
    retrieval_method. Queries that carry instrument or region meet only the chunks of theirs, and these count alone.

    model: that of the queries' vectors; an index of another one is an error.
    """
    if not 1 <= top_k <= 2 * depth:
        raise ValueError(f"top_k lies between 1 and {2 * depth}")
    if mode not in ("keyword", "dense", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if model:
        prepare.require_model(index.manifest, model)
    lexical, none = Lexical(index, queries), F.lit(None).cast("double")
    cols = ["query_id", "ord", "rank"]
    if mode == "keyword":
        got = lexical.best(top_k).select(*cols, none.alias("rrf_score"), F.col("score").alias("keyword_score"), none.alias("cosine_similarity"))
        return _named(got, index, mode)
    k = depth if mode == "hybrid" else top_k
    chunks, asked = index.vectors.select("chunk_id", "ord", "vector", *SCOPE), queries
    scope = None
    if {"instrument", "region"} & set(queries.columns):
        chunks, asked = retrieval.scoped(chunks, queries)
        scope = ["scope"]
    near = settle(ranked(retrieval.dense(chunks, asked, k, scope), k).select(*cols, "score"))
    if mode == "hybrid":
        keyword = settle(lexical.best(depth))
        id_of = lambda r: r.select("query_id", F.col("ord").cast("string").alias("chunk_id"), "ord", "rank")
        got = settle(ranked(fuse(id_of(keyword), id_of(near)), top_k, digits=12).select(*cols, F.col("score").alias("rrf_score")))
    else:
        keyword = near.limit(0)
        got = near.select(*cols, none.alias("rrf_score"))
    some = index.vectors.select("ord", F.col("vector").alias("__c")).join(sent(got.select("ord").distinct()), "ord", "left_semi")
    named = settle(index.chunks.select("chunk_id", "ord").join(sent(got), "ord").join(some, "ord", "left"))
    known = keyword.select("query_id", "ord", F.col("score").alias("keyword_score"))
    rest = lexical.of(named.join(sent(known), ["query_id", "ord"], "left_anti")).withColumnRenamed("score", "keyword_score")
    out = named.join(sent(queries.select("query_id", F.col("vector").alias("__q"))), "query_id").withColumn("cosine_similarity", retrieval.dot(F.col("__c"), F.col("__q")))
    out = out.join(sent(settle(known.unionByName(rest))), ["query_id", "ord"], "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    return out.select(*KEYS, "ord", "rank", "rrf_score", "keyword_score", "cosine_similarity", F.lit(mode).alias("retrieval_method"))


def _named(got: DataFrame, index: Index, mode: str) -> DataFrame:
    ids = index.chunks.select("ord", "chunk_id").join(sent(settle(got)), "ord")
    return ids.select(*KEYS, "ord", "rank", "rrf_score", "keyword_score", "cosine_similarity", F.lit(mode).alias("retrieval_method"))
