"""Vocabulary pruning, ties, bigrams; SVD invariants and degenerate cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from buzzscore.operators.lsa import components_from_gram, n_components_for
from buzzscore.operators.tfidf import TfidfParams, doc_terms, fit_vocabulary, row_vectors, with_terms
from buzzscore.plans.text import add_text_features, fit_and_featurize, fit_text_model


def _posts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "post_id long, content string")


def _vocab(spark, texts, **kw):
    posts = _posts(spark, texts)
    params = TfidfParams(**kw)
    return fit_vocabulary(doc_terms(posts, params), len(texts), params).table


def test_document_frequency_bounds(spark):
    # 20 posts: "common" in 17 (= 85 %, kept), "everywhere" in 18 (> 85 %, dropped),
    # "three" in 3 (kept), "two" in 2 (dropped).
    texts = []
    for i in range(20):
        words = ["filler%d" % i]
        if i < 17:
            words.append("common")
        if i < 18:
            words.append("everywhere")
        if i < 3:
            words.append("three")
        if i < 2:
            words.append("two")
        texts.append(" ".join(words))
    terms = set(_vocab(spark, texts, bigrams=False)["term"])
    assert "common" in terms and "three" in terms
    assert "everywhere" not in terms and "two" not in terms


def test_ties_at_the_cap_break_alphabetically(spark):
    texts = ["bbb aaa ccc"] * 3 + ["ddd"] * 3
    table = _vocab(spark, texts, bigrams=False, max_features=2)
    # all four terms have corpus count 3: the first two alphabetically win
    assert list(table["term"]) == ["aaa", "bbb"]
    assert list(table["term_id"]) == [0, 1]


def test_bigram_spans_removed_stop_word(spark):
    texts = ["market the rally"] * 3 + ["unrelated words here"]
    terms = set(_vocab(spark, texts)["term"])
    assert "market rally" in terms and "the" not in terms


def test_only_stop_words_is_an_error(spark):
    with pytest.raises(ValueError, match="0 features"):
        _vocab(spark, ["the and of", "a the", "of and"] * 2)


def test_idf_smoothing(spark):
    table = _vocab(spark, ["alpha beta", "alpha", "alpha beta gamma"] * 1, bigrams=False, min_df=1)
    row = table.set_index("term").loc["beta"]
    assert row["idf"] == pytest.approx(np.log(4 / 3) + 1)


def test_component_counts():
    assert n_components_for(1000, strict=True) == 20
    assert n_components_for(5, strict=True) == 4
    assert n_components_for(5, strict=False) == 5
    assert n_components_for(1, strict=False) == 1
    with pytest.raises(ValueError):
        n_components_for(1, strict=True)


def test_rank_one_gram_has_one_component():
    x = np.outer(np.arange(1, 6), np.array([1.0, 2.0, 0.0, 1.0]))
    v, sig = components_from_gram(x.T @ x, 3)
    assert v.shape == (4, 3)
    assert sig[0] > 0 and sig[1] == 0 and sig[2] == 0
    assert np.all(v[:, 1:] == 0)
    assert v[np.argmax(np.abs(v[:, 0])), 0] > 0  # sign rule


def test_svd_invariants_on_documents(spark):
    from buzzscore.sources.posts import documents_as_posts

    docs = documents_as_posts(spark, "/root/testdata/sf0.001")
    model, feats = fit_and_featurize(docs)
    v = model.components
    nz = model.singular_values > 0
    np.testing.assert_allclose(v[:, nz].T @ v[:, nz], np.eye(nz.sum()), atol=1e-9)
    pdf = feats.toPandas().set_index("post_id")
    cols = [f"text_feature_{i + 1}" for i in range(model.k)]
    sq = (pdf[cols] ** 2).sum(axis=0).to_numpy()
    np.testing.assert_allclose(sq, model.singular_values**2, rtol=1e-8, atol=1e-9)
    # every post with a vocabulary term has a unit-norm row, so trace(G) counts those posts
    rows = row_vectors(with_terms(docs, model.params), model.vocab).select("term_ids", "weights").toPandas()
    x = np.zeros((len(rows), model.vocab.size))
    for i, (ids, w) in enumerate(zip(rows["term_ids"], rows["weights"])):
        x[i, list(ids)] = list(w)
    full = np.linalg.svd(x, compute_uv=False)
    assert np.sum(full**2) == pytest.approx(sum(len(ids) > 0 for ids in rows["term_ids"]))
    np.testing.assert_allclose(model.singular_values, full[: model.k], rtol=1e-8, atol=1e-6)


def test_post_without_vocabulary_gets_zeros(spark):
    texts = ["alpha beta gamma"] * 4 + ["zzz qqq"]
    posts = _posts(spark, texts)
    model = fit_text_model(posts, TfidfParams(bigrams=False))
    out = add_text_features(posts, model).filter(F.col("post_id") == 4).first()
    assert all(out[f"text_feature_{i + 1}"] == 0.0 for i in range(model.k))


def test_model_save_load_roundtrip(spark, tmp_path):
    from buzzscore.operators.lsa import TextModel

    texts = ["alpha beta gamma", "beta gamma delta", "alpha delta"] * 3
    posts = _posts(spark, texts)
    model = fit_text_model(posts, TfidfParams(bigrams=False))
    model.save(spark, str(tmp_path / "m"))
    again = TextModel.load(spark, str(tmp_path / "m"))
    np.testing.assert_allclose(again.components, model.components)
    assert list(again.vocab.table["term"]) == list(model.vocab.table["term"])
