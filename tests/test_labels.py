"""Texts are not shuffled to their labels."""

import pytest

from quarry.plans import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def unsent(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_stay_where_they_are_read(spark, unsent, monkeypatch):
    whole = views.whole(spark, SF)
    assert "Exchange hashpartitioning" not in plan(whole) and "SortMergeJoin" not in plan(whole)
    assert "Exchange hashpartitioning" not in plan(views.sources(spark, SF))
    rows = sorted(map(str, whole.collect()))
    monkeypatch.setattr(views, "LABELS", 0)  # too many labels are joined, with the same rows
    assert sorted(map(str, views.whole(spark, SF).collect())) == rows
