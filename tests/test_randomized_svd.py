"""The randomized solver against the exact one and numpy."""

import numpy as np
import pytest

from buzzscore.operators.lsa import components_from_gram
from buzzscore.operators import randomized_svd as R
from buzzscore.operators.randomized_svd import components_randomized
from buzzscore.plans import queries as Q
from buzzscore.plans import text as T
from buzzscore.operators.tfidf import row_vectors
from buzzscore.session import written


def dense(vectors, n_terms):
    rows = vectors.select("term_ids", "weights").toPandas()
    x = np.zeros((len(rows), n_terms))
    for i, (ids, w) in enumerate(zip(rows["term_ids"], rows["weights"])):
        x[i, list(ids)] = list(w)
    return x


def test_equals_the_exact_solver(spark):
    rows, vocab = Q._vocab(spark, "/root/testdata/sf0.01")
    vectors = written(row_vectors(rows.select("terms"), vocab).repartition(40), "vectors")
    x = dense(vectors, vocab.size)
    v, sigma = components_from_gram(x.T @ x, 20)
    got_v, got = components_randomized(vectors, vocab.size, 20)
    np.testing.assert_allclose(got, sigma, rtol=1e-6)
    np.testing.assert_allclose(got_v.T @ got_v, np.eye(20), atol=1e-12)
    np.testing.assert_allclose(np.abs((got_v * v).sum(axis=0)), 1, atol=1e-3)


def vectors_of(spark, x, parts):
    rows = [([int(j) for j in np.flatnonzero(r)], [float(a) for a in r[np.flatnonzero(r)]]) for r in x]
    return spark.createDataFrame(rows, "term_ids array<int>, weights array<double>").repartition(parts)


@pytest.mark.parametrize("n, terms, k, parts", [(30, 12, 5, 3), (4, 50, 6, 7), (1, 3, 1, 1)])
def test_small_and_rank_deficient(spark, n, terms, k, parts):
    """Fewer terms than the basis has columns: exact; fewer posts than components: the rest is zero."""
    r = np.random.default_rng(n)
    x = r.random((n, terms)) * (r.random((n, terms)) < 0.4)
    x[0, 0] = 1.0
    v, sigma = components_randomized(vectors_of(spark, x, parts), terms, k)
    want = np.zeros(k)
    full = np.linalg.svd(x, compute_uv=False)[:k]
    want[: len(full)] = np.where(full < 1e-6 * full[0], 0, full)
    np.testing.assert_allclose(sigma, want, atol=1e-9)
    assert v.shape == (terms, k) and (v[:, sigma == 0] == 0).all()


def test_no_posts(spark):
    v, sigma = components_randomized(spark.createDataFrame([], "term_ids array<int>, weights array<double>"), 5, 2)
    assert (v == 0).all() and (sigma == 0).all()


def test_refuses_a_basis_that_fits_no_task(spark):
    with pytest.raises(ValueError, match="do not fit"):
        components_randomized(spark.range(0), 10_000_000, 20)


def test_large_vocabularies_use_it(spark, monkeypatch):
    """The choice is by the vocabulary, and both solvers give the same features."""
    posts = Q._docs(spark, "/root/testdata/sf0.001")
    exact = T.fit_text_model(posts)
    monkeypatch.setattr(T, "MAX_GRAM_TERMS", 10)
    again = T.fit_text_model(posts)
    np.testing.assert_allclose(again.singular_values, exact.singular_values, rtol=1e-6)


def test_what_a_pass_adds_up_is_bounded_by_the_cores(spark):
    """Posts in many partitions: a sum a core at most, and fewer if there are few entries; all rows are in."""
    r = np.random.default_rng(3)
    x = r.random((3000, 10)) * (r.random((3000, 10)) < 0.8)
    x[::7] = 0
    vectors, v = vectors_of(spark, x, 60), r.standard_normal((10, 4))
    rows = R.packed(vectors, 10)
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < 60
    np.testing.assert_allclose(R.gram_times(rows, v), x.T @ (x @ v))
    t = R.triangle(rows, v)
    np.testing.assert_allclose(t.T @ t, (x @ v).T @ (x @ v))
    few = R.packed(vectors_of(spark, x[:40], 8), 5000)
    assert few.rdd.getNumPartitions() == 1
    np.testing.assert_allclose(R.triangle(few, np.eye(10)).T @ R.triangle(few, np.eye(10)), x[:40].T @ x[:40], atol=1e-12)


def test_triangles_of_many_tasks_are_merged(spark):
    x = np.random.default_rng(5).random((400, 6))
    parts = vectors_of(spark, x, 40).mapInArrow(R.pack_rows(), "sizes binary, ids binary, weights binary")
    t = R.triangle(parts, np.eye(6))
    np.testing.assert_allclose(t.T @ t, x.T @ x)


def test_rows_longer_than_a_pack(spark):
    x = np.random.default_rng(4).random((7, 3000))
    rows = R.packed(vectors_of(spark, x, 2), 3000)
    v = np.random.default_rng(5).standard_normal((3000, 3))
    np.testing.assert_allclose(R.gram_times(rows, v), x.T @ (x @ v))
