"""Fit a text model on posts and add text features to posts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from buzzscore.operators.lsa import (
    MAX_COMPONENTS,
    TextModel,
    add_features,
    collect_gram,
    components_from_gram,
    feature_names,
    gram_matrix,
    n_components_for,
)
from buzzscore.operators.randomized_svd import components_randomized
from buzzscore.operators.sampling import DEFAULT_SEED, exact_sample
from buzzscore.operators.tfidf import MAX_GRAM_TERMS, TfidfParams, fit_vocabulary, row_vectors, token_terms, with_terms, with_tokens
from buzzscore.session import written


def fit_text_model(
    posts: DataFrame,
    params: TfidfParams | None = None,
    strict: bool = False,
    sample_size: int | None = None,
    seed: int = DEFAULT_SEED,
    n_components: int = MAX_COMPONENTS,
) -> TextModel:
    """Vocabulary + idf + SVD components, fitted on every post.

    Only if a ``sample_size`` is given (tolerant mode) is the model fitted on
    that many posts, a seeded sample.  Null content counts as ``''``.
    """
    params = params or TfidfParams()
    fit_set = posts.select("post_id", "content")
    if sample_size is not None and not strict:
        fit_set = exact_sample(fit_set, sample_size, seed)
    return fit_from_rows(written(with_tokens(fit_set, params).drop("content"), "tokens"), params, strict, n_components)


def fit_from_rows(
    rows: DataFrame, params: TfidfParams, strict: bool = False, n_components: int = MAX_COMPONENTS
) -> TextModel:
    """Fit on a written table of posts with their ``_tokens``.

    Vocabularies of up to ``MAX_GRAM_TERMS`` terms by the exact solver, larger
    ones by the randomized one.
    """
    n_docs = rows.count()
    vocab = fit_vocabulary(rows, n_docs, params)
    known = token_terms(rows.select("_tokens"), params, only=vocab.table["term"].tolist())
    vectors = row_vectors(known, vocab)
    k = n_components_for(vocab.size, strict, n_components)
    if vocab.size > MAX_GRAM_TERMS:
        v, sig = components_randomized(vectors, vocab.size, k)
    else:
        gram = collect_gram(gram_matrix(vectors, vocab.size, n_docs), vocab.size)
        v, sig = components_from_gram(gram, k)
    return TextModel(vocab, v, sig, params)


def fit_and_featurize(
    posts: DataFrame,
    params: TfidfParams | None = None,
    strict: bool = False,
    sample_size: int | None = None,
    seed: int = DEFAULT_SEED,
    n_components: int = MAX_COMPONENTS,
) -> tuple[TextModel, DataFrame]:
    """``(model, posts with text_feature_1..k)``.

    The posts and their tokens are written once (tokenising and whatever made
    the posts run once); the vocabulary, the Gram matrix and the features read
    the columns that they need.  All rows and columns of ``posts`` come back,
    also where ids are null or repeated.
    """
    params = params or TfidfParams()
    rows = written(with_tokens(posts, params), "posts")
    if sample_size is not None and not strict:
        model = fit_text_model(posts, params, strict, sample_size, seed, n_components)
    else:
        model = fit_from_rows(rows, params, strict, n_components)
    return model, add_features(token_terms(rows, model.params, only=model.vocab.table["term"].tolist()), model)


def add_text_features(posts: DataFrame, model: TextModel) -> DataFrame:
    """All rows and columns of ``posts`` and the model's features, in the row."""
    known = model.vocab.table["term"].tolist()
    return add_features(with_terms(posts, model.params, only=known), model)


__all__ = ["fit_and_featurize", "fit_text_model", "add_text_features", "feature_names"]
