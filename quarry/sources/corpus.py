"""A corpus table that changes all at once: rows are staged by partition, and one new version file makes them the table.

Layout: data/corpus_id=../model_id=../bucket=../stage=.. holds rows, versions/NNNNNNNNNN.json names the folders that are
the table. A job that dies before its version file is there leaves only folders that no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import hadoop, sent, settle
from .writers import require_vectors

PARTITION = ("corpus_id", "model_id", "bucket")
KEY = ("corpus_id", "model_id", "chunk_id")


class Conflict(ValueError):
    """Another commit has come first: read the table again."""


def bucket_of(source_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source_id), F.lit(buckets)).cast("int")


class Corpus:
    """chunks (or sources) of several corpora and models under path; buckets is fixed when the first rows come.

    Rows carry KEY, source_id and columns of their own. Those of one source stand in one bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        versions = self._versions()
        self.version = versions[-1] if versions else 0
        known = json.loads(spark.read.text(self._file(self.version), wholetext=True).first().value) if versions else {}
        self.buckets, self.folders = known.get("buckets", buckets), known.get("folders", {})
        self.schema = T.StructType.fromJson(known["schema"]) if known else None

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:010d}.json"

    def _versions(self) -> list[int]:
        fs, at = hadoop(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit() and n.endswith(".json"))

    def table(self) -> DataFrame:
        """The rows of this version. Filters on PARTITION leave whole folders unread."""
        if not self.folders:
            raise ValueError(f"there is no corpus in {self.path}")
        folders = [f"{self.path}/data/{part}/stage={stage}" for part, stage in sorted(self.folders.items())]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*folders).drop("stage")

    def scan(self, corpus_id: str, model_id: str, instrument: str = "all") -> DataFrame:
        """One corpus and model, of one instrument or all; an unknown one gives no rows."""
        rows = self.table().where((F.col("corpus_id") == corpus_id) & (F.col("model_id") == model_id)).drop("bucket")
        return rows if instrument == "all" else rows.where(F.col("instrument_id") == instrument)

    def lookup(self, corpus_id: str, model_id: str, ids: list[str]) -> DataFrame:
        """Rows of a few sources by their ids: only the buckets of these are read. Unknown ids give no rows."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "i string")
        hit = [r[0] for r in asked.select(bucket_of(F.col("i"), self.buckets)).distinct().collect()]  # at most one an id
        rows = self.table().where((F.col("corpus_id") == corpus_id) & (F.col("model_id") == model_id) & F.col("bucket").isin(hit))
        return rows.where(F.col("source_id").isin(ids)).drop("bucket")

    def upsert(self, rows: DataFrame) -> Corpus:
        """The corpus with rows in place of those of their KEY; this object goes on reading the table as it was.

        Only the partitions that rows fall into are written anew. Several rows of one key, or a null in it, fail the
        job before anything is seen. Raises Conflict if another commit has come meanwhile.
        """
        stage = uuid.uuid4().hex
        sound = F.when(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in KEY)), F.lit(True)).otherwise(F.raise_error(F.lit(f"a row of a corpus needs {', '.join(KEY)}")))
        new = settle(rows.where(sound).withColumn("bucket", bucket_of(F.col("source_id"), self.buckets)))
        if twice := new.groupBy(*KEY).count().where("count > 1").first():
            raise ValueError(f"two rows for chunk {twice.chunk_id}")
        touched = new.select(*PARTITION)
        if self.folders:
            # a chunk may have moved to another source, and so to another bucket
            old = self.table()
            touched = touched.unionByName(old.select(*PARTITION, "chunk_id").join(new.select(*KEY), list(KEY), "left_semi").select(*PARTITION))
        touched = settle(touched.distinct())
        if self.folders:
            stay = old.join(sent(touched), list(PARTITION), "left_semi").join(new.select(*KEY), list(KEY), "left_anti")
            new = new.unionByName(stay, allowMissingColumns=True)
        each = new.withColumn("stage", F.lit(stage)).repartition(*PARTITION, F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
        each.write.mode("append").partitionBy(*PARTITION, "stage").parquet(f"{self.path}/data")
        gone = {self._folder(r) for r in touched.collect()}  # a row for each partition
        return self._commit({k: v for k, v in self.folders.items() if k not in gone}, stage, each.schema)

    def _folder(self, r) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join(f"{c}={escaped(str(r[c]))}" for c in PARTITION)

    def _commit(self, kept: dict, stage: str, schema: T.StructType) -> Corpus:
        """Name the staged folders and those that stay in the next version file, put there by one rename."""
        jvm = self.spark._jvm
        fs, wild = hadoop(self.spark, f"{self.path}/data/{'/'.join(f'{c}=*' for c in PARTITION)}/stage={stage}")
        staged = {"/".join(s.getPath().toString().split("/")[-4:-1]): stage for s in fs.globStatus(wild) or []}
        body = json.dumps({"buckets": self.buckets, "folders": kept | staged, "schema": schema.jsonValue()})
        _, draft = hadoop(self.spark, f"{self.path}/versions/.draft-{stage}")
        out = fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        _, final = hadoop(self.spark, self._file(self.version + 1))
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # unlike FileSystem.rename(), never over a file that is there
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as failed:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {self.version + 1} of {self.path} is another commit's") from failed
            raise
        return Corpus(self.spark, self.path)


def commit_index(corpus: Corpus, chunks: DataFrame, manifest_row: DataFrame) -> Corpus:
    """An index's chunks as the corpus and model that its manifest names; all vectors are checked first."""
    m = manifest_row.select("corpus_sha256", "model_id", "dimension").first()
    return corpus.upsert(require_vectors(chunks, m.dimension).select(F.lit(m.corpus_sha256).alias("corpus_id"), F.lit(m.model_id).alias("model_id"), "*"))
