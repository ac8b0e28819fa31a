"""The bit-sliced index against integer products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from buzzscore.llm import topk as K
from buzzscore.llm.common import written


@pytest.mark.parametrize("value", [*range(-40, 41), 1023, -1024, 12345])
def test_signed_digits(value):
    digits = K.signed_digits(value)
    assert sum(s << t if s > 0 else -(1 << t) for s, t in digits) == value
    assert all(b - a > 1 for (_, a), (_, b) in zip(digits, digits[1:], strict=False))


@pytest.mark.parametrize("n, dims, top", [(1, 3, 5), (64, 1, 1), (130, 16, 600), (700, 8, 1 << 20), (10, 4, 0)])
def test_block_scores_and_selection(n, dims, top):
    r = np.random.default_rng(n)
    rows = r.integers(-top - 1, top + 1, (n, dims))
    rows[n // 2 :] = rows[: n - n // 2][::-1]  # ties
    block = K.BitSlicedBlock(rows)
    ids = r.permutation(n)
    for q in [*rows[:5], np.zeros(dims, int), -rows[0]]:
        slices, constant = block.scores(q)
        assert block.values(slices, constant, np.arange(n)) == (rows @ q).tolist()
        for k, without in ((10, None), (3, 0), (n + 5, None)):
            want = sorted((i for i in range(n) if i != without), key=lambda i: (-int(rows[i] @ q), ids[i]))[:k]
            assert sorted(block.top(slices, k, without, ids)) == sorted(want)


def test_search_of_a_table(spark):
    r = random.Random(4)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(400, [0.5] * 6), (401, [0.5] * 6), (402, [0.5] * 6), (500, [0.5] * 6)]  # ties
    rows += [(600, None), (601, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (700, [nan] * 6), (701, [inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (800, [])]
    rows += [(None, [0.9] * 6), (None, [0.9] * 6), (900, [1.0, 2.0]), (901, [3.0, -1.0])]
    rows += [(200, [0.7] * 6)]  # an id that is there twice
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    df = written(df.repartition(1), "vectors")
    read = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    sound = [
        (i, k, [math.floor(1024 * x) for x in v])
        for k, (i, v) in enumerate(read)
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = []
    for i, k, v in sound:
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, m, j) for j, m, w in sound if m != k and len(w) == len(v)]
        want += [(i, n + 1, s[4], -s[0]) for n, s in enumerate(sorted(scored)[:10])]
    for block_rows, chunk in ((1 << 15, 256), (50, 2)):
        out = K.top_k(df, F.col("vec_id") % 100 == 0, block_rows=block_rows, query_chunk=chunk)
        assert out.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.top_k(df, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert K.top_k(one, F.col("vec_id") % 100 == 0).count() == 0
