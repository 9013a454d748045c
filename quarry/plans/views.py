"""The engine's model over the given tables: sources, chunks, queries, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_tokens, tokens, unit
from ..operators import index, prepare
from ..operators.shared import hadoop, scratch, sent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Labels, of three numbers each, that go to every task; beyond that texts are shuffled to theirs.
LABELS = 2_000_000


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source documents; review_status and provenance from labels, which are sent to the texts."""
    docs, labels = table(spark, sf_dir, "documents"), sent(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), LABELS)
    status = F.when(F.col("quality") == 0, "pending").when(F.col("toxic") == 1, "fictional").when(F.col("quality") == 1, "reviewed").otherwise("source_verified")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("source_id"), F.concat_ws(" ", "source", F.lit("document"), "doc_id").alias("source_title"),
        F.concat(F.lit("https://example.org/"), "doc_id").alias("source_url"), F.lit("2026-01-01").alias("retrieved_at"), "text",
        F.col("lang").alias("language"), F.col("lang").alias("jurisdiction"), F.col("source").alias("instrument_id"), status.alias("review_status"),
        F.lit("official_legal_text").alias("source_kind"), F.lit("original_oj").alias("document_version"), F.lit("3").alias("celex"),
    )


def whole(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """A chunk for each document: chunk_id, ord, tokens and the source's columns."""
    body = F.col("text")
    out = sources(spark, sf_dir).withColumn("chunk_id", F.col("source_id")).withColumn("ord", F.col("doc_id"))
    return out.withColumn("char_start", F.lit(0).cast("long")).withColumn("tokens", plain_tokens(body) if plain else tokens(body))


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole() with the vector of that number; null where a document has none."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), unit(F.col("embedding")).alias("vector"))
    # tokens are taken behind the join, so that texts alone are moved
    return whole(spark, sf_dir).drop("tokens").join(v, "doc_id", "left").withColumn("tokens", tokens(F.col("text")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of with_vectors() that have a vector, by name and scope alone: no text is moved to its vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), unit(F.col("embedding")).alias("vector"))
    return whole(spark, sf_dir).select("doc_id", "chunk_id", "ord", "instrument_id", "jurisdiction").join(v, "doc_id")


def questions(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """benchmark as queries: query_id, query, terms, and the vector of that number; null where there is none."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("vector"))
    terms = plain_tokens(F.col("query"), query=True) if plain else tokens(F.col("query"))
    return b.withColumn("terms", terms).join(v, "query_id", "left")


#: The model of the given vectors.
MODEL = {"model_id": "given", "dimension": 64, "query_prefix": ""}
#: Indexes of this process: where the index of a session and of tables as they were lies.
_BUILT: dict[tuple, str] = {}


def indexed(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of whole() and vectors(), written to the shared folder when it is first asked for; tables whose files have
    changed since are indexed anew."""
    state = [spark.sparkContext.applicationId, sf_dir]
    for name in ("documents", "embeddings", "labels"):
        for file in sorted(table(spark, sf_dir, name).inputFiles()):
            fs, at = hadoop(spark, file)
            status = fs.getFileStatus(at)
            state.append((file, status.getLen(), status.getModificationTime()))
    key = tuple(state)
    if key not in _BUILT:
        chunks, path = whole(spark, sf_dir), scratch(spark, "index")
        index.write(path, chunks, sources(spark, sf_dir), lambda c: prepare.manifest(c.select("chunk_id", "text"), MODEL), vectors=vectors(spark, sf_dir))
        _BUILT[key] = path
    return index.read(spark, _BUILT[key])
