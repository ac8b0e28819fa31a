"""Truncated SVD of the TF-IDF matrix (latent semantic features).

X is the n x F matrix of L2-normalised TF-IDF rows (not centred).  Its right
singular vectors are the eigenvectors of the Gram matrix G = XᵀX, which is
F x F whatever n is.  G is summed in one pass: each task multiplies blocks of
its documents' rows and emits at most F(F+1)/2 non-zero cells; a ``groupBy``
adds the partials.  The driver only sees the summed F x F matrix and runs
``eigh`` on it.

Features of any post are then X·V, computed in the row from its own terms; the
vocabulary and V (at most ``max_features`` rows) travel with the function.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzscore.functions.pyhelpers import gram_partials, project_terms
from buzzscore.operators.tfidf import TfidfParams, Vocabulary

MAX_COMPONENTS = 20
RELATIVE_RANK_TOL = 1e-6


#: Posts that are worth a partial Gram matrix of their own.
POSTS_PER_PARTIAL = 2_500


def gram_matrix(vectors: DataFrame, n_terms: int, n_docs: int) -> DataFrame:
    """Upper-triangle cells ``(i, j, g)`` of XᵀX (non-zero cells only), from the
    rows' ``term_ids`` and ``weights``.

    Each task emits up to F(F+1)/2 cells, whatever the posts that it sums up,
    so the sparse rows are dealt to as many tasks as there are cores at most;
    a ``groupBy`` adds the partial sums.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    dealt = vectors.select("term_ids", "weights").repartition(max(1, min(cores, -(-n_docs // POSTS_PER_PARTIAL))))
    partial = dealt.mapInArrow(gram_partials(n_terms), "i int, j int, g double")
    return partial.groupBy("i", "j").agg(F.sum("g").alias("g"))


def collect_gram(gram: DataFrame, n_terms: int) -> np.ndarray:
    """Dense symmetric G on the driver (at most F(F+1)/2 cells arrive)."""
    pdf = gram.toPandas()
    g = np.zeros((n_terms, n_terms), dtype=np.float64)
    if len(pdf):
        i = pdf["i"].to_numpy()
        j = pdf["j"].to_numpy()
        g[i, j] = pdf["g"].to_numpy()
        g[j, i] = pdf["g"].to_numpy()
    return g


def n_components_for(n_terms: int, strict: bool, requested: int = MAX_COMPONENTS) -> int:
    """strict: min(k, F - 1) (an error if that is < 1); tolerant: min(k, max(1, F))."""
    if strict:
        k = min(requested, n_terms - 1)
        if k < 1:
            raise ValueError(f"n_components must be >= 1, got {k} (only {n_terms} feature)")
        return k
    return min(requested, max(1, n_terms))


def components_from_gram(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top-k right singular vectors V (F x k) and singular values.

    Each column's sign makes its largest-magnitude entry positive (ties: the
    lowest term id).  Negative eigenvalues are clipped to 0 and components
    with σ below 1e-6·σ₁ are zeroed (they are numerical noise).
    """
    evals, evecs = np.linalg.eigh(g)
    order = np.argsort(-evals, kind="stable")[:k]
    sig = np.sqrt(np.clip(evals[order], 0.0, None))
    return fix_signs(evecs[:, order], sig, k)


def fix_signs(v: np.ndarray, sig: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Components with the sign rule and the cut of weak ones, padded with zeros to ``k``."""
    v = v.copy()
    for c in range(v.shape[1]):
        col = v[:, c]
        pivot = int(np.argmax(np.abs(col)))
        if col[pivot] < 0:
            v[:, c] = -col
    if len(sig) and sig[0] > 0:
        weak = sig < RELATIVE_RANK_TOL * sig[0]
    else:
        weak = np.ones_like(sig, dtype=bool)
    v[:, weak] = 0.0
    sig = np.where(weak, 0.0, sig)
    if v.shape[1] < k:  # fewer terms than components
        v = np.hstack([v, np.zeros((v.shape[0], k - v.shape[1]))])
        sig = np.concatenate([sig, np.zeros(k - len(sig))])
    return v, sig


@dataclass
class TextModel:
    """Fitted text model: vocabulary with idf and SVD components."""

    vocab: Vocabulary
    components: np.ndarray  # F x k
    singular_values: np.ndarray
    params: TfidfParams

    @property
    def k(self) -> int:
        return int(self.components.shape[1])

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as one small Parquet table plus a JSON sidecar row."""
        meta = {
            "n_docs": self.vocab.n_docs,
            "singular_values": self.singular_values.tolist(),
            "params": {
                "max_features": self.params.max_features,
                "min_df": self.params.min_df,
                "max_df": self.params.max_df,
                "bigrams": self.params.bigrams,
                "accent_fold": self.params.accent_fold,
                "stop_words": list(self.params.stop_words),
            },
        }
        t = self.vocab.table[["term", "term_id", "df", "cf", "idf"]].copy()
        t["v"] = [row.tolist() for row in self.components]
        schema = "term string, term_id int, df bigint, cf bigint, idf double, v array<double>"
        spark.createDataFrame(t, schema).coalesce(1).write.mode("overwrite").parquet(
            os.path.join(path, "terms")
        )
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
            "overwrite"
        ).json(os.path.join(path, "meta"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextModel":
        meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
        t = spark.read.parquet(os.path.join(path, "terms")).toPandas().sort_values("term_id")
        t = t.reset_index(drop=True)
        comps = np.array([np.asarray(v, dtype=np.float64) for v in t["v"]])
        p = meta["params"]
        params = TfidfParams(
            max_features=p["max_features"],
            min_df=p["min_df"],
            max_df=p["max_df"],
            bigrams=p["bigrams"],
            accent_fold=p["accent_fold"],
            stop_words=tuple(p["stop_words"]),
        )
        vocab = Vocabulary(t[["term", "term_id", "df", "cf", "idf"]], meta["n_docs"])
        return cls(vocab, comps, np.asarray(meta["singular_values"]), params)


def add_features(df: DataFrame, model: TextModel, terms_col: str = "terms") -> DataFrame:
    """Replace ``terms`` by ``text_feature_1..k`` = normalised TF-IDF row · V.

    Computed in the row: no join and no shuffle, whatever ids the rows have.
    Posts without any vocabulary term get zeros.
    """
    table = model.vocab.table
    run = project_terms(table["term"].tolist(), table["idf"].to_numpy(), model.components)
    keep = [c for c in df.columns if c != terms_col]
    out = df.withColumn("_f", F.arrow_udf(run, "array<double>")(F.col(terms_col)))
    return out.select(*keep, *[F.col("_f")[c].alias(name) for c, name in enumerate(feature_names(model.k))])


def feature_names(k: int) -> list[str]:
    return [f"text_feature_{c + 1}" for c in range(k)]


__all__ = [
    "TextModel",
    "add_features",
    "collect_gram",
    "components_from_gram",
    "feature_names",
    "gram_matrix",
    "n_components_for",
]
