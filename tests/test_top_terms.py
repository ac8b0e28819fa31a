"""Frequent-items summaries, against exact counts."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from buzzscore.functions.pyhelpers import frequent_items
from buzzscore.operators.tfidf import TfidfParams, exploded_terms, fit_vocabulary, with_terms
from buzzscore.operators.top_terms import fit_vocabulary_by_summary
from buzzscore.session import written


def posts(spark, seed, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 40))), "x") for i in range(n)]
    rows += [(n, None, "x"), (n, "", "x"), (n + 1, "w1 " * 50 + "burst " * 300, "x")]
    return spark.createDataFrame(rows, "post_id long, content string, n string").repartition(6)


@pytest.mark.parametrize("capacity, spare, features", [(8, 1, 20), (50, 1, 60), (1 << 16, 3, 100)])
def test_equals_exact_counts(spark, capacity, spare, features):
    """Also from far too few counters and candidates, which are raised until the proof holds; ``burst`` is in one post only."""
    params = TfidfParams(max_features=features, bigrams=True)
    rows = written(with_terms(posts(spark, capacity), params).drop("content"), "terms")
    want = fit_vocabulary(exploded_terms(rows), rows.count(), params)
    got, proof = fit_vocabulary_by_summary(rows, rows.count(), params, capacity, spare)
    assert got.table.equals(want.table)
    assert proof.rarest_kept > proof.others_at_most or proof.others_at_most == 0
    assert "burst" not in set(got.table["term"])


def test_fewer_terms_than_wanted(spark):
    params = TfidfParams(max_features=1000, min_df=1, max_df=1.0, bigrams=False)
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc")], "post_id long, content string")
    rows = written(with_terms(df, params).drop("content"), "terms")
    got, _ = fit_vocabulary_by_summary(rows, 2, params, 1, 1)
    assert dict(zip(got.table["term"], got.table["cf"])) == {"aa": 2, "bb": 2, "cc": 1}


def test_nothing_left(spark):
    params = TfidfParams()
    rows = written(with_terms(spark.createDataFrame([], "post_id long, content string"), params).drop("content"), "terms")
    with pytest.raises(ValueError):
        fit_vocabulary_by_summary(rows, 0, params)


@pytest.mark.parametrize("capacity", [1, 3, 10, 100])
def test_a_summary_is_off_by_no_more_than_it_says(capacity):
    r = random.Random(capacity)
    true, batches = Counter(), []
    for _ in range(30):
        rows = [[{"term": f"t{int(r.paretovariate(0.6))}", "tf": r.randint(1, 3)} for _ in range(r.randint(0, 9))] for _ in range(5)]
        for t in (t for row in rows for t in row):
            true[t["term"]] += t["tf"]
        kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
        batches.append(pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["terms"]))
    out = [x for b in frequent_items(capacity)(iter(batches)) for x in b.to_pylist()]
    off = next(x["n"] for x in out if x["term"] is None)
    held = {x["term"]: x["n"] for x in out if x["term"] is not None}
    assert len(held) <= capacity and off <= sum(true.values()) / (capacity + 1)
    assert all(n - off <= held.get(t, 0) <= n for t, n in true.items())
