import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.operators import prepare
from quarry.plans import catalogue
from quarry.sources import readers, writers
from quarry.streaming import events


def test_jsonl_with_mark_and_blank_lines(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text("﻿" + json.dumps({"source_id": "a", "text": "x"}) + "\n\n" + json.dumps({"source_id": "b"}) + "\n", encoding="utf-8")
    assert [r.source_id for r in readers.read_jsonl(spark, str(p)).orderBy("source_id").collect()] == ["a", "b"]


def test_markdown_headers(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nsource_id: "a"\nsource_title: T: one\nsource_url: \'u\'\nretrieved_at: 2026\n---\nBody\n')
    r = readers.read_markdown(spark, str(tmp_path)).first()
    assert (r.source_id, r.source_title, r.source_url, r.text) == ("a", "T: one", "u", "Body")
    (tmp_path / "b.md").write_text("no header")
    with pytest.raises(Exception, match="no source_id"):
        readers.read_markdown(spark, str(tmp_path)).collect()


def test_odd_headers(spark):
    pages = ["---\ntitle: a---\nx: 1\n---\nb", "---\n---\n b ", "---\nk: 1\nk: \"'2'\"\n---\n", "no header\n", "---\nk: 1\nno end", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, t string")
    head, body = readers.header_and_body(F.col("t"))
    got = {r.i: (r.h, r.b) for r in rows.select("i", head.alias("h"), body.alias("b")).collect()}
    assert got == {0: ({"title": "a---", "x": "1"}, "b"), 1: ({}, "b"), 2: ({"k": "2"}, ""), 3: ({}, "no header"), 4: ({}, "---\nk: 1\nno end"), 5: ({}, None)}


def test_articles_are_whole_or_say_why(spark):
    body = "<html><head><title>x</title></head><body><p class='a eli-main-title'>Act <b>2024/1</b></p><div id='art_1'><p>Article 1</p><p/><p>" + "It shall <b>not</b> apply. " * 8 + "</p></div></body></html>"
    pages = [(body, "2024/1", [1]), (body, "2024/2", [1]), (body, "2024/1", [2]), (body.replace("</div>", "loose</div>"), "2024/1", [1]), (body.replace("<body>", "<body><div id='art_1'/>"), "2024/1", [1]), ("<!ENTITY x>" + body, "2024/1", [1]), (None, "2024/1", [1])]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, body string, number string, wanted array<int>")
    got = {r.i: r for r in readers.articles(rows).collect()}
    assert got[0].broken == [] and got[0].article_text.startswith("Article 1\n\nIt shall not apply.")
    assert got[1].broken == ["other_publication"] and "missing" in got[2].broken and got[3].broken == ["text_outside_paragraphs"] and "repeated_id" in got[4].broken
    assert "not_xhtml" in got[5].broken and "not_xhtml" in got[6].broken
    named = rows.where("i = 0").selectExpr("*", "'x' as id", "'X' as name", "'3' as celex", "'2024-01-01' as publication_date")
    doc = readers.article_documents(named, "2026-01-01").first()
    assert doc.source_id == "x-oj-art-1" and doc.section == "Article 1" and len(doc.source_sha256) == 64
    cover = {r.instrument_id: (r.articles, r.characters) for r in readers.import_coverage(readers.article_documents(named, "2026-01-01")).collect()}
    assert cover == {"x": (1, len(doc.text)), None: (1, len(doc.text))}
    with pytest.raises(Exception, match="other_publication"):
        readers.article_documents(named.withColumn("number", F.lit("9")), "2026-01-01").collect()
    spec = spark.createDataFrame([("a", [1, 1]), ("b", [1]), ("b", [2])], "id string, articles array<int>")
    assert {(r.id, r.article) for r in readers.catalogue_repeats(spec).collect()} == {("a", 1), ("b", None)}


def test_old_chunks_pins_and_snapshots(spark, tmp_path):
    one = {"chunk_id": "a::chunk-001", "source_id": "a", "text": "t"}
    (tmp_path / "list.json").write_text(json.dumps([one, one]))
    (tmp_path / "object.json").write_text(json.dumps({"chunks": [one]}))
    assert [readers.read_chunks(spark, str(tmp_path / n)).count() for n in ("list.json", "object.json")] == [2, 1]
    found = readers.checksums(spark, str(tmp_path / "list.json"))
    pins = {"list.json": found.first().sha256.upper(), "gone.bin": "0" * 64}
    assert {r.name: r.matches for r in readers.pinned(found, pins).collect()} == {"list.json": True, "gone.bin": False}
    docs = spark.createDataFrame([("a", "x")], "source_id string, text string")
    writers.write_snapshot(str(tmp_path / "s"), docs, docs)
    with pytest.raises(Exception):
        writers.write_snapshot(str(tmp_path / "s"), docs, docs)


def test_encoder_hook_and_corpus_table(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", "three")], "chunk_id string, text string")
    model = {"model_id": "m", "dimension": 2, "query_prefix": "q: "}
    encoder = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    words = lambda c: F.size(F.split(c, " "))
    got = prepare.encoded(rows, F.col("text"), encoder, words, 2, 8, "q: ")
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-12 for r in got.collect())
    for bad in ((encoder, 3, 8), (encoder, 2, 1), (lambda c: F.array(F.lit(0.0), F.lit(0.0)), 2, 8)):
        with pytest.raises(Exception):
            prepare.encoded(rows, F.col("text"), bad[0], words, bad[1], bad[2]).collect()
    m = prepare.manifest(rows, model)
    prepare.require_model(m, model)
    with pytest.raises(ValueError, match="differ"):
        prepare.require_model(m, model | {"dimension": 3})
    table = writers.corpus_upsert(None, got, m)
    again = writers.corpus_upsert(table, got.limit(1), m)
    assert table.count() == again.count() == 2 and again.columns[:2] == ["corpus_id", "model_id"]


def test_allowed_urls(spark):
    urls = ["https://eur-lex.europa.eu/a", "http://eur-lex.europa.eu/a", "https://eur-lex.europa.eu:8443/a", "https://u@eur-lex.europa.eu/", "https://x.org/eur-lex.europa.eu", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(readers.allowed_url(F.col("u"))).collect()] == [True, False, False, False, False, False]


def test_index_is_not_overwritten_and_vectors_are_checked(spark, tmp_path):
    c = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, vector array<double>")
    writers.write_index(str(tmp_path / "i"), c, c, writers.corpus_digest(c), 2)
    assert writers.read_index(spark, str(tmp_path / "i"))["manifest"].first().chunks == 1
    with pytest.raises(Exception):
        writers.write_index(str(tmp_path / "i"), c, c, c)
    with pytest.raises(Exception, match="bad vector"):
        writers.require_vectors(c, 3).collect()


def test_late_events_by_window(spark, tmp_path):
    src = spark.sql("select 1L event_id, timestamp'2026-01-01 00:10:00' ts, 1L user_id, 'view' event_type, 2.0D value, '' props union all select 2L, timestamp'2026-01-01 00:50:00', 1L, 'view', 3.0D, '' union all select 3L, timestamp'2026-01-02 00:00:00', 1L, 'view', 1.0D, ''")
    src.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = events.windowed(events.read_events(spark, str(tmp_path / "e"))).writeStream.outputMode("append").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.events, r.total) for r in spark.table("counts").collect()] == [(2, 5.0)]


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) <= set(entry.queries())
