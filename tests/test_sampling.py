"""The exact sample against a full ordering by key."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from buzzscore.operators import sampling
from buzzscore.operators.tfidf import TfidfParams, with_terms


def order(i, seed=42):
    return "" if i is None else hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.mark.parametrize("listed", [1, 4096])
def test_against_full_ordering(spark, monkeypatch, listed):
    monkeypatch.setattr(sampling, "LISTED", listed)
    ids = [None, None, *range(300), *[7] * 40, *[8] * 9]
    df = spark.createDataFrame([(i, "x") for i in ids], "post_id int, content string").repartition(3)
    by_key = sorted(map(order, ids))
    for n in (0, 1, 2, 3, 100, 200, len(ids) - 1, len(ids), len(ids) + 5):
        got = [r.post_id for r in sampling.exact_sample(df, n).collect()]
        assert Counter(map(order, got)) == Counter(by_key[:n]), n
    assert sampling.exact_sample(df.limit(0), 3).count() == 0


def test_sample_is_a_filter(spark):
    df = spark.range(5000).select(F.col("id").alias("post_id"))
    got = sampling.exact_sample(df, 2500)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 2500


def test_terms_of_a_vocabulary_only(spark):
    df = spark.createDataFrame([("big data big deal",), (None,), ("nothing known",)], "content string")
    every = with_terms(df, TfidfParams()).select("terms").collect()
    some = with_terms(df, TfidfParams(), only=["big", "data big"]).select("terms").collect()
    assert [[t for t in r.terms if t.term in ("big", "data big")] for r in every] == [r.terms for r in some]
    assert [tuple(t) for t in some[0].terms] == [("big", 2), ("data big", 1)]
