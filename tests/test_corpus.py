"""Tests of the corpus table: commits all at once, partitions that are not asked for stay unread."""

import pytest
from pyspark.sql import functions as F

from quarry.sources.corpus import Conflict, Corpus, commit_index

COLS = "corpus_id string, model_id string, chunk_id string, source_id string, instrument_id string, text string"


def chunk(corpus, model, i, text="old"):
    return (corpus, model, f"c{i}", f"s{i // 3}", f"i{i % 2}", text)


def content(table):
    return {(r.corpus_id, r.model_id, r.chunk_id): (r.source_id, r.text) for r in table.collect()}


def test_rows_of_a_key_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "c")
    first = Corpus(spark, path, buckets=4).upsert(spark.createDataFrame([chunk(c, m, i) for c in ("007", "b") for m in ("org/model=1", "n") for i in range(12)], COLS))
    assert first.version == 1 and first.table().count() == 48
    changed = [chunk("007", "n", i, "new") for i in (2, 5, 40)] + [("007", "n", "c7", "elsewhere", "i1", "moved")]
    second = first.upsert(spark.createDataFrame(changed, COLS))
    want = {(c, m, f"c{i}"): (f"s{i // 3}", "old") for c in ("007", "b") for m in ("org/model=1", "n") for i in range(12)}
    want |= {("007", "n", f"c{i}"): (f"s{i // 3}", "new") for i in (2, 5, 40)} | {("007", "n", "c7"): ("elsewhere", "moved")}
    assert content(second.table()) == want and second.version == 2
    assert content(Corpus(spark, path).table()) == want
    assert content(first.table())["007", "n", "c2"] == ("s0", "old")  # a reader goes on with what it opened
    # partitions that the new rows do not fall into keep their folders
    assert all(second.folders[k] == v for k, v in first.folders.items() if "corpus_id=b" in k or "model_id=org" in k)
    with pytest.raises(Conflict):
        first.upsert(spark.createDataFrame([chunk("b", "n", 1, "late")], COLS))
    assert content(Corpus(spark, path).table()) == want


def test_a_job_that_dies_leaves_the_old_corpus(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    old = Corpus(spark, path).upsert(spark.createDataFrame([chunk("a", "m", i) for i in range(9)], COLS))
    new = spark.createDataFrame([chunk("a", "m", i, "new") for i in range(9)], COLS)
    boom = new.withColumn("text", F.when(F.col("chunk_id") == "c8", F.raise_error(F.lit("half-way"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="half-way"):
        old.upsert(boom)
    # killed after the rows were written, before the version was
    monkeypatch.setattr(Corpus, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        old.upsert(new)
    monkeypatch.undo()
    assert {t for _, t in content(Corpus(spark, path).table()).values()} == {"old"}
    assert {t for _, t in content(Corpus(spark, path).upsert(new).table()).values()} == {"new"}


def test_scan_and_lookup_read_their_partitions(spark, tmp_path):
    rows = [chunk(c, m, i) for c in ("a", "b") for m in ("m", "n") for i in range(60)]
    corpus = Corpus(spark, str(tmp_path / "c"), buckets=8).upsert(spark.createDataFrame(rows, COLS))
    scan = corpus.scan("a", "n", "i1")
    assert scan.count() == 30 and set(scan.columns) == set(COLS.replace(" string", "").split(", "))
    plan = scan._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(corpus_id" in plan and "PushedFilters: [IsNotNull(instrument_id)" in plan
    found = corpus.lookup("a", "n", ["s3", "s4", "nobody"])
    assert sorted(r.chunk_id for r in found.collect()) == sorted(f"c{i}" for i in range(9, 15))
    one = corpus.lookup("a", "n", ["s3"])
    scanned = {f.split("/stage=")[0] for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(scanned) == 1 and "bucket" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert corpus.scan("zzz", "n").count() == 0
    with pytest.raises(ValueError, match="no corpus"):
        Corpus(spark, str(tmp_path / "none")).scan("a", "n")


def test_bad_rows_and_vectors_change_nothing(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c")).upsert(spark.createDataFrame([chunk("a", "m", 1)], COLS))
    for bad, told in (([chunk("a", "m", 2), chunk("a", "m", 2, "again")], "two rows"), ([("a", None, "c3", "s", "i", "x")], "needs")):
        with pytest.raises(Exception, match=told):
            corpus.upsert(spark.createDataFrame(bad, COLS))
    manifest = spark.createDataFrame([("digest", "m", 2)], "corpus_sha256 string, model_id string, dimension int")
    chunks = spark.createDataFrame([("c1", "s", [1.0, 0.0]), ("c2", "s", [0.0, 0.0])], "chunk_id string, source_id string, vector array<double>")
    with pytest.raises(Exception, match="bad vector"):
        commit_index(corpus, chunks, manifest)
    assert Corpus(spark, str(tmp_path / "c")).version == 1
    both = commit_index(corpus, chunks.limit(1), manifest)
    assert both.version == 2 and both.scan("digest", "m").first().vector == [1.0, 0.0] and both.scan("a", "m").count() == 1
    assert both.scan("a", "m").first().vector is None  # columns that only one of them has
