import random

from pyspark.sql import functions as F

from quarry.functions import text as fx
from quarry.operators import chunking, prepare

SOURCE = dict(source_id="a", source_title="T", source_url="https://x.org/a", retrieved_at="2026-01-01", text="hello world", review_status="reviewed", source_kind="document", document_version="v", celex="")


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first()[0]


def test_clean_keeps_structure_and_drops_control_characters(spark):
    dirty = " éa\x00b  \r\nc\t d \r\n\n\n\ne​ "
    assert one(spark, dirty, fx.clean(F.col("t"))) == "éab\nc\t d\n\ne​"


def test_tokens_keep_repeats_and_pair_cjk(spark):
    assert one(spark, "The Cat cat 法律文 x 一", fx.tokens(F.col("t"))) == ["cat", "cat", "x", "法律", "律文", "一"]


def test_first_words_keep_their_spacing(spark):
    assert one(spark, " a  b\nc d", fx.first_words(F.col("t"), F.lit(3))) == " a  b\nc"


def test_character_windows_are_exact_spans(spark):
    rng = random.Random(3)
    for text in ["", " ", "x" * 5001, "".join(rng.choice("ab \n\t") for _ in range(1500)), "y" * 280 + "\n\n    z"]:
        got = [(r["start"], r["text"]) for r in one(spark, text, chunking.character_windows(F.col("t")))]
        want = []
        for i in range(0, len(text), 280):
            raw = text[i : i + 320]
            if raw.strip():
                want.append((i + len(raw) - len(raw.lstrip()), raw.strip()))
        assert got == want
        assert all(text[s : s + len(t)] == t for s, t in got)


def test_paragraph_windows_cover_all_text_and_end():
    rng = random.Random(4)
    for text in ["x" * 5001, "".join(rng.choice("abc. \n") for _ in range(6000))]:
        got = chunking.cut_paragraphs(text, 1200, 160)
        assert all(text[s : s + len(t)] == t and len(t) <= 1200 for s, t in got)
        seen = set()
        for s, t in got:
            seen.update(range(s, s + len(t)))
        assert all(i in seen for i, c in enumerate(text) if not c.isspace())


def test_markdown_pieces_pack_greedily(spark):
    rng = random.Random(5)
    for _ in range(5):
        parts = ["w" * rng.randint(1, 700) for _ in range(rng.randint(1, 12))] + ["v" * 1000]
        want = []
        for p in parts:
            if want and len(want[-1]) + 2 + len(p) <= 900:
                want[-1] += "\n\n" + p
            else:
                want.append(p)
        assert one(spark, "\n\n".join(parts), chunking.markdown_pieces(F.col("t"))) == want


def test_rules_name_what_is_wrong(spark):
    bad = [SOURCE, SOURCE | {"source_id": "b c"}, SOURCE | {"source_id": "d", "source_url": "ftp://x", "retrieved_at": "then", "review_status": "x", "text": " "}, SOURCE | {"source_id": "e", "review_status": "source_verified"}, SOURCE]
    rows = {(r.source_id): set(r.broken) for r in prepare.violations(spark.createDataFrame(bad)).collect()}
    assert rows == {"a": {"duplicate"}, "b c": {"source_id"}, "d": {"required", "source_url", "retrieved_at", "review_status"}, "e": {"provenance"}}


def test_repeats_stay_for_private_books_and_other_sources(spark):
    text = "z" * 280
    docs = [SOURCE | {"text": text * 4}, SOURCE | {"source_id": "b", "text": text * 4}, SOURCE | {"source_id": "c", "text": text * 4, "source_kind": "private_book"}]
    n = {r.source_id: r["count"] for r in prepare.prepare(spark.createDataFrame(docs)).groupBy("source_id").count().collect()}
    assert n["a"] == n["b"] < n["c"]
