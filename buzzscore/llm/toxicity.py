"""Toxicity scores: a logistic regression on hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours and pairs with
one word between them, hashed to ``2 ** BITS`` coordinates.  The learner is
FTRL-proximal: every coordinate has a learning rate of its own, and the L1 term
keeps the weight of most coordinates at exactly zero.  The weights that remain
(a few thousand) go out with the scoring function; scoring is one pass over the
texts without a shuffle.

The learner reads labelled rows one after another, in the seeded order of their
ids, and keeps only its two vectors: memory does not depend on the rows.  It
learns from at most ``max_rows`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzscore.llm.common import fresh

BITS = 20
#: Labelled rows to learn from, at most.
MAX_ROWS = 20_000
#: A model of more weights is refused: it travels with every task.
MAX_WEIGHTS = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: Column) -> Column:
    """Hashes of the words: lower-cased runs of letters and digits; none for a null text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)


def coordinates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words, pairs of neighbours, and pairs over one word (each as long as it has members)."""
    h = words.view(np.uint64) if words.dtype == np.int64 else words.astype(np.int64).view(np.uint64)
    mixed = (h ^ (h >> np.uint64(31))) * _SKIP
    return (
        _bucket(h),
        _bucket(mixed[:-1] + (h[1:] ^ np.uint64(1)) * _ODD),
        _bucket(mixed[:-2] + (h[2:] ^ np.uint64(2)) * _SKIP),
    )


@dataclass
class Ftrl:
    """FTRL-proximal for binary labels and features that are there or not."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 1.0
    #: the error on label 1, the rarer one, counts so many times
    positive: float = 3.0

    def __post_init__(self):
        # one more coordinate than the features: the bias, without L1
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / step)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, 1 << BITS)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * (self.positive if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learner = Ftrl()
    for batch in batches:
        for words, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            learner.learn(np.unique(np.concatenate(coordinates(np.asarray(words.values)))), label)
    w = learner.weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    at: np.ndarray  # sorted coordinates
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
    epochs: int = 3,
    seed: int = 11,
) -> ToxicityModel:
    """Learn from the texts of ``docs`` whose ids ``labels`` marks 0 or 1; other labels, null too, are left out.

    An id that is labelled more than once has its largest label.  Beyond
    ``max_rows`` the ids that come first in a seeded order are taken; that
    table of two numbers a row is broadcast, so no other text is moved.
    Without any row the model gives 0.5 to every text.
    """
    order = F.xxhash64(F.lit(seed), F.col("id"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("id IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.select("id", "y", order.alias("o")).orderBy("o", "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.select("o", "id", "y", tokens(F.col("text")).alias("words"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    # another order in each epoch; one learner, so one partition of a bounded table
    rows = rows.withColumn("o", F.xxhash64("epoch", "o")).repartition(1).sortWithinPartitions("epoch", "o", "id", "y")
    got = rows.select("words", "y").mapInArrow(_train, "at long, weight double").limit(MAX_WEIGHTS + 2).toPandas()
    if len(got) > MAX_WEIGHTS + 1:
        raise ValueError(f"the model has more than {MAX_WEIGHTS} weights")
    got = got.sort_values("at")
    inner = got[got["at"] < 1 << BITS]
    return ToxicityModel(
        float(got.loc[got["at"] == 1 << BITS, "weight"].sum()), inner["at"].to_numpy(), inner["weight"].to_numpy()
    )


def margins(words: pa.Array, dense: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's distinct coordinates; ``words`` is a list array."""
    starts = words.offsets.to_numpy()
    flat = words.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    lengths = np.diff(starts)
    of = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros(len(lengths))
    texts, at = [], []
    for gap, found in enumerate(coordinates(flat)):
        hit = dense[found] != 0
        if gap:
            hit &= of[:-gap] == of[gap:]  # no pair across texts
        rows = np.flatnonzero(hit)
        texts.append(of[rows])
        at.append(found[rows])
    pairs = np.unique((np.concatenate(texts).astype(np.int64) << BITS) | np.concatenate(at))
    np.add.at(out, pairs >> BITS, dense[pairs & ((1 << BITS) - 1)])
    return out


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, and ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    * Null, empty and wordless texts get the model's bias.
    * Texts of any length are read whole; repeated rows get the same score.
    * Nothing but the text is an input. Columns of ``docs`` that have a result's
      name are kept; the result then carries underscores in front.
    """
    bias = model.bias
    at, weight = model.at.astype(np.int32), model.weight.astype(np.float32)
    cache: dict[str, np.ndarray] = {}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "dense" not in cache:
            cache["dense"] = np.zeros(1 << BITS, np.float32)
            cache["dense"][at] = weight
        for words in batches:
            m = bias + margins(words, cache["dense"])
            yield pa.array(np.round(1 / (1 + np.exp(-np.clip(m, -30, 30))), 9))

    name, label = fresh(docs, "score"), fresh(docs, "predicted")
    rate = F.arrow_udf(run, "double")
    out = docs.withColumn(name, rate(tokens(F.col(text_col))))
    return out.withColumn(label, (F.col(name) >= 0.5).cast("int"))
