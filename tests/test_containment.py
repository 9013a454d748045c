"""Items are looked for in texts that are neither moved nor exploded."""

import random

import pytest

from quarry.operators.containment import containing
from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_are_looked_for_in_texts_that_are_not_exploded(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c", "dé", "e."], k=rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "a\tb c dé  e.", "x  a b c dé e.y", "one"]
    items = [(i, text) for i, text in enumerate(["a b c dé e.", "b c dé e. a b", "a  b c dé e.", "a\tb c dé  e.", "one", "e.", "", " a b c a b ", None, "a b c dé e."])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    asked = spark.createDataFrame(items, "query_id long, query string")
    want = {(q, d) for q, item in items for d, t in enumerate(texts) if item is not None and t is not None and item in t}
    found = containing(docs, asked, step=7)
    assert "Exchange" not in plan(found) and "Generate" not in plan(found)
    assert {tuple(r) for r in found.collect()} == want
    assert {tuple(r) for r in containing(docs, asked, most=1).collect()} == want
    assert containing(docs, asked.limit(0)).collect() == [] and containing(docs.limit(0), asked).collect() == []
    monkeypatch.setattr(catalogue, "containing", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalogue._cases(spark, SF)
