"""Merged day sketches against exact counts and ranks, for every range of days."""

import datetime as dt
import random

from buzzscore.operators.day_sketches import day_sketches, distinct_error, over_ranges, rank_error

D0 = dt.date(2024, 1, 1)


def test_every_range_within_its_error(spark):
    rnd = random.Random(3)
    rows = [(dt.datetime(2024, 1, 1 + min(int(rnd.expovariate(0.4)), 7)), rnd.randrange(4000), rnd.gauss(0, 1)) for _ in range(20_000)]
    posts = spark.createDataFrame(rows, "t timestamp, u int, v double").repartition(5)
    days = [D0 + dt.timedelta(days=i) for i in range(8)]
    ranges = [(a, b) for i, a in enumerate(days) for b in days[i:]]
    # the days' rows of two batches merge like those of one
    first, second = day_sketches(posts.where("u % 3 = 0"), "t", "u", "v"), day_sketches(posts.where("u % 3 > 0"), "t", "u", "v")
    got = over_ranges(first.unionByName(second), spark.createDataFrame(ranges, "first_day date, last_day date"), (0.1, 0.5, 0.9))
    got = {(r.first_day, r.last_day): r for r in got.collect()}
    assert set(got) == set(ranges)
    for (a, b), r in got.items():
        inside = [(u, v) for t, u, v in rows if a <= t.date() <= b]
        users = len({u for u, _ in inside})
        assert r.n == len(inside)
        assert abs(r["distinct"] - users) <= max(1, 4 * distinct_error() * users)
        for rank, q in zip((0.1, 0.5, 0.9), r.quantiles):
            below = sum(v < q for _, v in inside) / len(inside)
            upto = sum(v <= q for _, v in inside) / len(inside)
            assert below - 2 * rank_error() <= rank <= upto + 2 * rank_error()


def test_nulls_and_empty(spark):
    kind = "t timestamp, u int, v double"
    posts = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), None, None), (dt.datetime(2024, 1, 1), 1, float("nan")), (None, 2, 1.0)], kind
    )
    ranges = spark.createDataFrame([(D0, D0), (D0, D0), (D0 + dt.timedelta(days=5), D0 + dt.timedelta(days=9))], "first_day date, last_day date")
    got = over_ranges(day_sketches(posts, "t", "u", "v"), ranges).collect()
    assert [(r.n, r["distinct"], r.quantiles) for r in got] == [(2, 1, [None])]
    assert over_ranges(day_sketches(posts.limit(0), "t", "u", "v"), ranges).count() == 0
