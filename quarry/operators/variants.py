"""Variants of an index over the same sources: whether they may be compared, and how each does on the same cases."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import index as indexes
from . import review
from .shared import let, met, sent, settle

MODEL = ("model_id", "dimension", "query_prefix")


def _halves(columns: list[str]) -> Column:
    """A row's 128-bit digest as two whole numbers; columns in the order of their names."""
    hexes = F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))
    half = lambda h, at: F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(38,0)")
    return let(hexes, lambda h: F.struct(half(h, 1).alias("high"), half(h, 17).alias("low")))


def digest(rows: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """(bucket, n, high, low): how many rows each bucket of key holds, and the sums of their digests' halves.

    Sums do not depend on the order of rows, and repeated rows count; no more than a row a bucket and task is shuffled.
    """
    own = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), _halves(rows.columns).alias("d"))
    return own.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("d.high").alias("high"), F.sum("d.low").alias("low"))


def differences(first: DataFrame, second: DataFrame, key: str = "source_id", buckets: int = 1024) -> DataFrame:
    """(key, kind) of keys whose rows differ: missing, extra or changed in second; no rows if the two are equal.

    Snapshots with different columns differ in all rows. Rows are compared only in the buckets whose digests differ.
    """
    a, b = (digest(df, key, buckets) for df in (first, second))
    same = a.join(b.select("bucket", *[F.col(c).alias(f"b_{c}") for c in ("n", "high", "low")]), "bucket", "full")
    off = settle(same.where(~F.coalesce((F.col("n") == F.col("b_n")) & (F.col("high") == F.col("b_high")) & (F.col("low") == F.col("b_low")), F.lit(False))).select("bucket"))
    at = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")

    def of(df: DataFrame, name: str) -> DataFrame:
        some = df.withColumn("bucket", at).join(sent(off), "bucket", "left_semi").select(F.col(key), _halves(df.columns).alias("d"))
        return some.groupBy(key).agg(F.struct(F.count("*").alias("n"), F.sum("d.high").alias("high"), F.sum("d.low").alias("low")).alias(name))

    x, y = of(first, "x"), of(second, "y").withColumnRenamed(key, "__key")
    both = x.join(y, F.col(key).eqNullSafe(F.col("__key")), "full")
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") != F.col("y"), "changed")
    return both.select(F.coalesce(key, "__key").alias(key), kind.alias("kind")).where("kind is not null")


def require_comparable(variants: dict[str, indexes.Index], key: str = "source_id") -> None:
    """An error that names the variant, and a source or the model, if variants do not stand on the same ones."""
    if not variants:
        raise ValueError("there are no variants to compare")
    (base, first), *others = variants.items()
    if first.sources.isEmpty():
        raise ValueError(f"variant {base} has no sources")
    model = first.manifest.select(*MODEL).first()
    for name, other in others:
        if other.manifest.select(*MODEL).first() != model:
            raise ValueError(f"variant {name} is of another model than {base}")
        wrong = differences(first.sources, other.sources, key).first()
        if wrong:
            raise ValueError(f"variant {name}: source {wrong[0]} is {wrong[1]}, compared with {base}")


def compare(variants: dict[str, indexes.Index], datasets: dict[str, DataFrame], mode: str = "hybrid", top_k: int = 12, most: int = 5) -> DataFrame:
    """variant, dataset, query_id, query, relevant, candidates, evidence, elapsed_ms: what each variant gives for each case.

    datasets: cases with query_id, query, relevant, terms, vector, reason (why a query is refused, or null), and
    instrument and region if they are scoped. candidates are the sources of the first hits, evidence those of them that
    the gate lets through, by the chunk's own text. All cases of a variant and dataset are one job, so elapsed_ms is
    the job's time over its cases, the same for each. Variants that may not be compared are an error.
    """
    from ..functions.text import tokens

    require_comparable(variants)
    out = None
    for name, index in variants.items():
        for dataset, cases in datasets.items():
            start = time.perf_counter()
            asked = settle(cases)
            got = settle(indexes.search(index, asked.where("reason is null"), mode, top_k))
            about = index.chunks.select("chunk_id", "source_id", "review_status", tokens(F.col("text")).alias("body"))
            hits = settle(met(got, about, "chunk_id")).join(sent(asked.select("query_id", "terms")), "query_id")
            one = review.diverse(hits, most)
            one = one.withColumn("good", F.coalesce(review.supported(one, h_terms="body"), F.lit(False)))
            named = lambda rows: F.transform(F.array_sort(rows), lambda x: x["source_id"])
            place = F.struct("place", "source_id")
            lists = one.groupBy("query_id").agg(named(F.collect_list(place)).alias("candidates"), named(F.collect_list(F.when(F.col("good"), place))).alias("evidence"))
            none = F.array().cast("array<string>")
            rows = settle(asked.join(lists, "query_id", "left").select("query_id", "query", "relevant", F.coalesce("candidates", none).alias("candidates"), F.coalesce("evidence", none).alias("evidence")))
            took = (time.perf_counter() - start) * 1000 / max(1, rows.count())
            rows = rows.select(F.lit(name).alias("variant"), F.lit(dataset).alias("dataset"), "*", F.lit(took).alias("elapsed_ms"))
            out = rows if out is None else out.unionByName(rows)
    return out
