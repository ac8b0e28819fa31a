"""Sessions, as-of joins and interval joins against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from buzzscore.operators.reports import signal_cube
from buzzscore.operators.time_joins import asof_join, interval_join, sessions

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return None if s is None else T0 + dt.timedelta(seconds=s)


def hot_rows(seed, n, span):
    """Half of the rows belong to one key; ties, null keys and null times are among them."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice(["hot", "hot", "a", "b", None])
        rows.append((i, key, None if rnd.random() < 0.05 else rnd.randrange(span)))
    return rows


def test_sessions(spark):
    rows = hot_rows(1, 400, 5000)
    df = spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "i int, k string, t timestamp")
    for gap in (1, 7, 60):
        want = set()
        for key in {k for _, k, _ in rows}:
            times = sorted(t for _, k, t in rows if k == key and t is not None)
            start = 0
            for j in range(1, len(times) + 1):
                if j == len(times) or times[j] - times[j - 1] > gap:
                    want.add((key, at(times[start]), at(times[j - 1]), j - start))
                    start = j
        got = [tuple(r) for r in sessions(df, ["k"], "t", gap).collect()]
        assert len(got) == len(want) and set(got) == want
    assert sessions(df.limit(0), ["k"], "t", 5).count() == 0


@pytest.mark.parametrize("width", [None, 1, 40, 100_000])
@pytest.mark.parametrize("strictly", [False, True])
@pytest.mark.parametrize("tolerance", [None, 25])
def test_asof(spark, width, strictly, tolerance):
    left, right = hot_rows(2, 150, 900), hot_rows(3, 60, 900)
    a = spark.createDataFrame([(i, k, at(t), "x") for i, k, t in left], "i int, k string, t timestamp, payload string")
    b = spark.createDataFrame([(i, k, at(t), "y") for i, k, t in right], "i int, k string, t timestamp, payload string")
    out = asof_join(a, b, ["k"], "t", "t", ["i"], strictly=strictly, tolerance_seconds=tolerance, slice_seconds=width)
    got = {r.i: r.match and r.match.i for r in out.collect()}
    assert out.columns == ["i", "k", "t", "payload", "match"] and len(got) == len(left)
    for i, k, t in left:
        fits = [
            (u, j) for j, m, u in right
            if k is not None and t is not None and m == k and u is not None and (u < t if strictly else u <= t)
        ]
        best = max(fits, default=None)
        if best and tolerance is not None and t - best[0] > tolerance:
            best = None
        assert got[i] == (best and best[1]), (i, k, t)


def test_asof_repeated_rows_and_empty_sides(spark):
    a = spark.createDataFrame([(1, "k", at(5)), (1, "k", at(5))], "i int, k string, t timestamp")
    assert [r.match.i for r in asof_join(a, a, ["k"], "t", "t", ["i"]).collect()] == [1, 1]
    assert [r.match for r in asof_join(a, a.limit(0), ["k"], "t", "t", ["i"]).collect()] == [None, None]
    assert asof_join(a.limit(0), a, ["k"], "t", "t", ["i"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(a.withColumnRenamed("i", "match"), a, ["k"], "t", "t", ["i"])


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("width", [1, 60])
def test_intervals(spark, by, width):
    rnd = random.Random(4)
    points = hot_rows(5, 120, 5000)
    spans = []
    for j in range(60):
        s = rnd.randrange(5000)
        length = rnd.choice([0, 1, 3, 59, 60, 61, 128, 1000, 100_000, -5])
        spans.append((j, rnd.choice(["hot", "a", None]), s, None if j % 17 == 0 else s + length))
    p = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "i int, k string, t timestamp")
    q = spark.createDataFrame([(j, k, at(s), at(e)) for j, k, s, e in spans], "j int, k string, s timestamp, e timestamp")
    if not by:
        q = q.drop("k")
    out = interval_join(p, q, "t", "s", "e", by=by, bin_seconds=width)
    want = sorted(
        (i, j) for i, k, t in points for j, m, s, e in spans
        if t is not None and e is not None and s <= t <= e and (not by or (k is not None and k == m))
    )
    assert sorted((r.i, r.j) for r in out.select("i", "j").collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_empty_and_clash(spark):
    p = spark.createDataFrame([(1, at(3))], "i int, t timestamp")
    q = spark.createDataFrame([(1, at(0), at(9))], "j int, s timestamp, e timestamp")
    assert interval_join(p, q.limit(0), "t", "s", "e").count() == 0
    assert interval_join(p.limit(0), q, "t", "s", "e").count() == 0
    with pytest.raises(ValueError):
        interval_join(p, q.withColumnRenamed("j", "i"), "t", "s", "e")


def test_cube_shares_and_nulls(spark):
    df = spark.createDataFrame(
        [(at(0), "BUY", "#a"), (at(0), "HOLD", "#a"), (at(0), "HOLD", None), (None, "HOLD", "#a")],
        "timestamp timestamp, trading_signal string, hashtags string",
    )
    cube = signal_cube(df).collect()
    total = [r for r in cube if r.level == 7]
    assert [(r.posts, r.percent) for r in total] == [(4, 100.0)]
    per_label = {r.label: r.percent for r in cube if r.level == 5}
    assert per_label == {"BUY": 25.0, "HOLD": 75.0}
    assert {(r.day, r.tag, r.posts) for r in cube if r.level == 2} == {(T0.date(), "#a", 2), (T0.date(), None, 1), (None, "#a", 1)}
    for r in cube:
        same = [x for x in cube if x.level & 5 == r.level & 5 and (x.day, x.tag) == (r.day, r.tag) and x.level & 2 == 0]
        assert sum(x.posts for x in same) == [x.posts for x in cube if x.level == r.level | 2 and (x.day, x.tag) == (r.day, r.tag)][0]
