"""Randomized truncated SVD of the TF-IDF matrix, for vocabularies of any size in reach of a task.

X is n x F, its rows are the posts' sparse vectors.  The Gram matrix of
:mod:`buzzscore.operators.lsa` needs F x F cells in every task; here a task
holds F x l, with l some more than the components wanted.

* *Range finder*: a seeded random F x l block V; each step replaces it by
  XᵀXV, one pass over the posts.  A task multiplies its rows with V and back
  and emits a row per term that it has; a ``groupBy`` adds them.  There are no
  more tasks than cores, so the rows that move do not grow with the posts.  Every new block is made orthogonal to all before
  (block Krylov), so the basis K has (steps + 1) blocks.
* *Tall-skinny QR*: one more pass computes XK, n x |K|, which is never stored:
  each task keeps the triangle R of its rows, and triangles are merged by QR of
  ``FAN_IN`` at a time until one is left.  R has the singular values of XK, and
  its right singular vectors turn K into those of X.

The seed decides the block, so equal input gives equal components whatever the
tasks, but for rounding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzscore.functions.pyhelpers import PACKED, pack_rows, range_step, triangle_of_rows, triangle_of_triangles
from buzzscore.operators.lsa import fix_signs
from buzzscore.session import written

OVERSAMPLE = 10
POWER_STEPS = 8
FAN_IN = 16
SEED = 20
#: Cells of the basis, F x |K|, that go to every task (8 bytes each).
MAX_CELLS = 40_000_000


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of ``block`` that is orthogonal to ``basis``, as orthonormal columns; dependent ones go."""
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    size = np.abs(np.diag(r))
    return q[:, size > 1e-10 * max(1.0, size.max(initial=0.0))]


#: Bytes of a row group of the packed rows: the reader holds one at a time.
ROW_GROUP = 16 << 20
#: Entries for each term that are worth a task: it gives out a row a term.
ENTRIES_PER_TERM = 8


def packed(vectors: DataFrame, n_terms: int) -> DataFrame:
    """The rows ``term_ids, weights`` as bytes, written once, to be read in a task a core at most.

    What a task gives out has F rows, however few its posts.
    """
    rows = vectors.select("term_ids", "weights").mapInArrow(pack_rows(), "sizes binary, ids binary, weights binary")
    rows = written(rows, "packed", **{"parquet.block.size": ROW_GROUP})
    worth = rows.count() * PACKED // (n_terms * ENTRIES_PER_TERM)
    return rows.coalesce(max(1, min(worth, vectors.sparkSession.sparkContext.defaultParallelism)))


def gram_times(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """XᵀXV: one pass over the packed rows; the driver gets F rows of l numbers."""
    names = [f"c{i}" for i in range(v.shape[1])]
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v))
    partial = rows.mapInArrow(range_step(sent), "term_id int, " + ", ".join(f"{c} double" for c in names))
    sums = partial.groupBy("term_id").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    sent.destroy()
    out = np.zeros(v.shape)
    out[sums["term_id"].to_numpy()] = sums[names].to_numpy()
    return out


def triangle(rows: DataFrame, k: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of XK, X in packed rows: a triangle a task, merged ``FAN_IN`` at a time."""
    schema = "part long, r array<double>"
    width = k.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(k))
    level = written(rows.mapInArrow(triangle_of_rows(sent), schema), "triangles")
    sent.destroy()
    while level.count() > 1:
        groups = level.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("long"))
        merged = groups.groupBy("group").applyInPandas(triangle_of_triangles(width), schema)
        level = written(merged.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")), "triangles")
    row = level.first()
    return np.zeros((width, width)) if row is None else np.array(row.r).reshape(width, width)


def components_randomized(
    vectors: DataFrame,
    n_terms: int,
    k: int,
    seed: int = SEED,
    oversample: int = OVERSAMPLE,
    power_steps: int = POWER_STEPS,
) -> tuple[np.ndarray, np.ndarray]:
    """Top-k right singular vectors (F x k) and singular values of the rows ``term_ids, weights``.

    Signs are those of the exact solver: each column's largest entry is
    positive.  With fewer terms than the basis would have columns it spans all,
    and the result is exact.  Components without a singular value above 1e-6 of
    the first are zero.
    """
    block = min(n_terms, k + oversample)
    if n_terms * min(n_terms, block * (power_steps + 1)) > MAX_CELLS:
        raise ValueError(f"{n_terms} terms by {block * (power_steps + 1)} columns do not fit a task")
    rows = packed(vectors, n_terms)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((n_terms, block)), np.zeros((n_terms, 0)))
    last = basis
    for _ in range(power_steps):
        if basis.shape[1] >= n_terms or not last.shape[1]:
            break
        last = _orthonormal(gram_times(rows, last), basis)[:, : n_terms - basis.shape[1]]
        basis = np.hstack([basis, last])
    _, sigma, w = np.linalg.svd(triangle(rows, basis))
    v, sigma = basis @ w[:k].T, sigma[:k]
    return fix_signs(v, sigma, k)


__all__ = ["components_randomized", "gram_times", "packed", "triangle"]
