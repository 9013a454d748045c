"""Writers: an index that is never overwritten, chunk lines, and a corpus table that is replaced by whole partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """rows; a vector of another length, of zero length or with a component that is no number fails the job."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce((F.size("vector") == dimension) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    return rows.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad vector of "), F.coalesce("chunk_id", F.lit("null"))))))


def write_index(path: str, chunks: DataFrame, sources: DataFrame, manifest: DataFrame, dimension: int | None = None) -> None:
    """chunks, sources and manifest under path; fails if there is one already."""
    for name, rows in (("chunks", require_vectors(chunks, dimension) if dimension else chunks), ("sources", sources), ("manifest", manifest)):
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "sources", "manifest")}


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def corpus_digest(chunks: DataFrame) -> DataFrame:
    """One row: chunks, corpus_sha256. A digest of bucket digests, so that nothing is gathered whole."""
    rows = chunks.select("chunk_id", F.sha2(F.to_json(F.struct(*sorted(chunks.columns))), 256).alias("h"))
    buckets = rows.groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(4096)).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return buckets.agg(F.sum("n").alias("chunks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("corpus_sha256"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def corpus_upsert(old: DataFrame | None, chunks: DataFrame, manifest_row: DataFrame) -> DataFrame:
    """The corpus table (corpus_id, model_id, and chunks' columns) with an index's chunks in place of those of their key.

    All vectors are checked first: one that is not of the manifest's dimension fails the job, and nothing is changed.
    """
    m = manifest_row.select("corpus_sha256", "model_id", "dimension").first()
    new = require_vectors(chunks, m.dimension).select(F.lit(m.corpus_sha256).alias("corpus_id"), F.lit(m.model_id).alias("model_id"), "*")
    return new if old is None else upserted(old, new, ["corpus_id", "model_id", "chunk_id"])


def write_once(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A report, snapshot or review export in a folder of its own; an existing one fails the write."""
    rows.write.mode("errorifexists").format(kind).save(path)


def write_snapshot(path: str, documents: DataFrame, coverage: DataFrame) -> None:
    """An import: the documents as lines, and their coverage by instrument; neither is ever overwritten."""
    write_once(documents, f"{path}/documents")
    write_once(coverage, f"{path}/coverage")


def write_reviews(path: str, answers: DataFrame, rendered: DataFrame) -> None:
    """Reviews as records, and as Markdown by query; neither is ever overwritten."""
    write_once(answers, f"{path}/evidence")
    write_once(rendered, f"{path}/markdown")
