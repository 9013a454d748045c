"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated lines go, sources are
mixed to their targets, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scratch, table
from quarry.llm.mixing import mixed
from quarry.llm.packing import pack
from quarry.llm.simhash import keep_one
from quarry.llm.toxicity import learn, without_toxic
from quarry.llm.unit_dedup import PRODUCTION, deduplicated


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labelled ones among them.

    Null and empty texts have no hits and stay; without labels of both classes every score is the toxic share.
    """
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five words and a similarity of 0.8: the smallest doc_id.

    Blank texts are one group.
    """
    return keep_one(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines and passages that an earlier one has; n_chars follows the text.

    Null texts stay null and empty ones empty, null doc_ids rank last, repeated rows are one document.
    """
    out = deduplicated(docs, **PRODUCTION)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated or left out so that sources come near their targets; null sources are one source.

    Texts without words go, as nothing is taken of them.
    """
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeats too, and their places in sequences of at most 1024 tokens."""
    return pack(docs, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("line_dedup", drop_repeated_lines),
    ("source_mixing", mix_sources),
    ("harmonic_packing", pack_sequences),
]

#: A learned classifier, fingerprints and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder and read again; an empty table stays empty."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
