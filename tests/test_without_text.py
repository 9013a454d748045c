"""Documents without text: the queries give what their SQL gives, and the operators still refuse them by themselves."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import text as fx
from quarry.operators import prepare
from quarry.plans import views

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf0.001 with 28 more documents: empty, blank and null texts, one of each by every rest of seven and more."""
    at = tmp_path_factory.mktemp("without_text")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = F.element_at(F.array(F.lit(""), F.lit(" \n\t"), F.lit(None)), (F.col("id") % 3 + 1).cast("int"))
    more = spark.range(1000, 1028).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 20).alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs.unionByName(more).write.parquet(str(at / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(at / "labels.parquet"))
    return str(at)


def both(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, folder).select(*want.columns)
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, (tuple(r) for r in want.fetchall())))


def test_chunks_of_documents_without_text(spark, folder):
    got, want = both(spark, folder, "chunk_dedupe")
    assert got == want and got
    docs = views.sources(spark, folder)
    with pytest.raises(Exception, match="breaks: required"):
        prepare.prepare(docs.where("doc_id >= 1000")).collect()
    with pytest.raises(Exception, match="breaks: required"):
        prepare.prepare(docs.withColumn("source_title", F.lit(" ")), needs_text=False).collect()


def test_chunk_schema_of_documents_without_text(spark, folder):
    got, want = both(spark, folder, "chunk_schema_violations")
    assert got == want and got
    rows = views.whole(spark, folder).where("doc_id >= 1000").select(*[c for c in prepare.CHUNK_FIELDS if c != "content_sha256"], F.sha2(F.lit(""), 256).alias("content_sha256"))
    assert {tuple(r.broken) for r in prepare.chunk_violations(rows).collect()} == {("no text",)}


def test_retrieval_text_keeps_the_lines_of_empty_parts(spark, folder):
    got, want = both(spark, folder, "retrieval_text_context")
    assert got == want and any("\\nen\\n'" in row for row in got)
    skipped = spark.createDataFrame([("T", "", "x"), ("T", "s", "")], "a string, b string, c string").select(fx.retrieval_text(*map(F.col, "abc")))
    assert [r[0] for r in skipped.collect()] == ["T\nx", "T\ns"]


@pytest.mark.parametrize("column", ["lang", "source", "text"])
def test_retrieval_text_of_null_parts(spark, folder, tmp_path, column):
    kind = spark.read.parquet(f"{folder}/documents.parquet").schema[column].dataType
    rows = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 3").withColumn(column, F.lit(None).cast(kind))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got, want = both(spark, str(tmp_path), "retrieval_text_context")
    assert got == want and all("None" in row for row in got)


@pytest.mark.parametrize("name", ["source_validation_report", "source_violations"])
def test_sources_without_text_break_no_rule(spark, folder, name):
    got, want = both(spark, folder, name)
    assert got == want and got
    assert prepare.violations(views.sources(spark, folder)).where("array_contains(broken, 'required')").count() == 28
