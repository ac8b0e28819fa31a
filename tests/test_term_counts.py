"""Terms counted in Arrow functions: as many as there are, whatever the tasks hold."""

import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buzzscore.functions.pyhelpers import _kept_tokens, combine_terms, count_terms
from buzzscore.operators import tfidf as T
from buzzscore.operators.tfidf import TfidfParams, doc_terms, fit_vocabulary, row_term_stats, term_stats, with_terms, with_tokens
from buzzscore.session import written

TEXTS = ["Big data, big DATA beats the small data", "", None, "the of", "Übergröße überall überall", "x_1 日本 x_1 日本", "big data"]


def test_a_task_holds_few_terms_and_loses_none():
    rows = [f"w{i} w{i + 1} w0 w0" for i in range(40)]
    batches = [pa.RecordBatch.from_pydict({"t": rows[i : i + 7]}) for i in range(0, 40, 7)]
    parts = list(combine_terms((), True, 10)(iter(batches)))
    assert len(parts) > 3 and max(len(p) for p in parts) <= 10 + 8
    df, cf = Counter(), Counter()
    for p in parts:
        for t, d, c in zip(*(p.column(k).to_pylist() for k in range(3))):
            df[t] += d
            cf[t] += c
    assert (df["w0"], cf["w0"], cf["w0 w0"], df["w5"]) == (40, 81, 40, 2)


def test_counts_by_task_are_those_by_row(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "post_id long, content string")
    for bigrams in (True, False):
        params = TfidfParams(bigrams=bigrams)
        want = sorted(map(tuple, term_stats(doc_terms(df, params)).collect()))
        assert sorted(map(tuple, row_term_stats(with_tokens(df, params), len(TEXTS), params).collect())) == want


def test_terms_are_sorted_with_counts_and_rows_stay(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "post_id long, content string")
    got = {r.post_id: [(t.term, t.tf) for t in r.terms] for r in with_terms(df, TfidfParams()).collect()}
    assert got[0] == [("beats", 1), ("beats small", 1), ("big", 2), ("big data", 2), ("data", 3), ("data beats", 1), ("data big", 1), ("small", 1), ("small data", 1)]
    assert got[1] == got[2] == got[3] == []
    assert ("uberall", 2) in got[4] and got[5] == [("x_1", 2), ("x_1 日本", 2), ("日本", 2), ("日本 x_1", 1)]


def test_the_shuffle_of_terms_grows_with_the_posts(spark):
    df = with_tokens(spark.range(2).select(F.col("id").alias("post_id"), F.lit("big data").alias("content")), TfidfParams())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert row_term_stats(df, 20_000_000, TfidfParams()).rdd.getNumPartitions() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def many_texts(n=300):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["über", "日本", "the"]
    texts = [" ".join(words[min(int(r.expovariate(0.12)), 62)] for _ in range(r.randint(0, 30))) for _ in range(n)]
    return texts + [None, "", "x" * 3000, "the " * 50]


@pytest.mark.parametrize("max_features, min_df, max_df, bigrams", [(40, 3, 0.85, True), (5000, 2, 0.3, True), (25, 0.02, 1.0, False), (300, 1, 1.0, True)])
@pytest.mark.parametrize("bits", [3, 14])
def test_two_passes_give_the_same_vocabulary(spark, monkeypatch, max_features, min_df, max_df, bigrams, bits):
    """Also where nearly all buckets are shared, tasks give their sums out early, and ties stand at the last place."""
    params = TfidfParams(max_features=max_features, min_df=min_df, max_df=max_df, bigrams=bigrams)
    texts = many_texts()
    rows = written(with_tokens(spark.createDataFrame(list(enumerate(texts)), "post_id long, content string").repartition(5), params), "tokens")
    want = fit_vocabulary(rows, len(texts), params).table
    monkeypatch.setattr(T, "ONE_PASS_POSTS", 0)
    monkeypatch.setattr(T, "BUCKET_BITS", bits)
    monkeypatch.setattr(T, "HELD_TERMS", 20)
    pd.testing.assert_frame_equal(fit_vocabulary(rows, len(texts), params).table, want)


def test_bigrams_that_come_once_are_not_added_up_one_by_one(spark, monkeypatch):
    """Beyond ``ONE_PASS_POSTS`` posts, what is added up does not grow with the bigrams that are too rare."""
    monkeypatch.setattr(T, "ONE_PASS_POSTS", 100)
    seen = []
    monkeypatch.setattr(T, "frequent_term_stats", lambda *a, f=T.frequent_term_stats: seen.append(f(*a)) or seen[-1])
    texts = [f"big data u{i} v{i} u{i}" for i in range(400)]
    rows = written(with_tokens(spark.createDataFrame(list(enumerate(texts)), "post_id long, content string"), TfidfParams()), "tokens")
    vocab = fit_vocabulary(rows, 400, TfidfParams(max_features=5, max_df=1.0))
    assert vocab.table[["term", "df", "cf"]].values.tolist() == [["big", 400, 400], ["big data", 400, 400], ["data", 400, 400]]
    assert seen[0].count() == 3


def test_counts_of_known_terms_are_those_of_all_terms():
    texts = [" ".join(t.split()) if t else t for t in many_texts()]
    tokens, stop = pa.array(texts), ("the", "w3")
    only = ["w1", "w1 w2", "w2 w1", "w0 w0", "über", "日本", "the", "w1 the", "w3", "w2 w2 w2", "never seen", "w40", "w1"]
    for bigrams in (True, False):
        every = count_terms(stop, bigrams)(tokens).to_pylist()
        want = [[e for e in row if e["term"] in set(only)] for row in every]
        assert count_terms(stop, bigrams, only)(tokens).to_pylist() == want
        assert count_terms(stop, bigrams, only)(tokens.slice(3, 200)).to_pylist() == want[3:203]
        assert count_terms(stop, bigrams, [])(tokens).to_pylist() == [[] for _ in texts]


def test_posts_are_split_some_at_a_time():
    texts = many_texts(40)
    pieces = list(_kept_tokens(pa.array(texts), ("the",), 100))
    assert len(pieces) > 10 and [p[0] for p in pieces] == [0, *(p[1] for p in pieces[:-1])] and pieces[-1][1] == len(texts)
    got = [(int(r), words[int(c)].as_py()) for _, _, rows, codes, words in pieces for r, c in zip(rows, codes)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").split() if w != "the"]
