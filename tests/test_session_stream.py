"""Sessions of a stream against the batch operator; late rows; a run after a run."""

import datetime as dt
import random
import uuid

import pandas as pd
from pyspark.sql import functions as F

from buzzscore.operators.time_joins import sessions
from buzzscore.session import scratch_path
from buzzscore.streaming.session_stream import merge_spans, run_sessions, stitch

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, t timestamp, _closes boolean"


def arrive(spark, source, rows):
    data = [(i, k, None if t is None else T0 + dt.timedelta(seconds=t), closes) for i, k, t, closes in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_spans():
    rows = [("a", 0, 5, 2), ("a", 3, 4, 2), ("a", 6, 6, 1), ("a", 8, 9, 1), ("", 7, 7, 1), ("", 8, 8, 1)]
    got = merge_spans(pd.DataFrame(rows[::-1], columns=["key", "first_us", "last_us", "n_events"]), 1)
    assert {tuple(r) for r in got.itertuples(index=False)} == {("a", 0, 6, 5), ("a", 8, 9, 1), ("", 7, 8, 2)}


def test_stream_equals_batch_and_counts_late_rows(spark):
    home = scratch_path(spark, f"session-stream-{uuid.uuid4().hex}")
    source, rnd = f"{home}/arrivals", random.Random(5)
    key = lambda: rnd.choice(["hot", "hot", "a", "b", None])
    rows = [(i, key(), rnd.randrange(3000), False) for i in range(300)] + [(900, "a", None, False)]
    run = lambda: run_sessions(spark, source, home, spark.read.parquet(source).schema, ["k"], "t", 20, 100, slice_seconds=200, lanes=3)

    # rows come in order of time, give or take 40 seconds
    rows.sort(key=lambda r: (r[2] or 0) + rnd.randrange(40))
    arrive(spark, source, rows[:120])
    arrive(spark, source, rows[120:200])
    first = run()
    assert first.agg(F.sum("late_rows")).first()[0] == 0
    # one row comes far too late, then the rest, then the end
    arrive(spark, source, [(901, "late", 0, False)])
    arrive(spark, source, rows[200:])
    arrive(spark, source, [(None, None, 5000, True)])
    second = run()
    assert second.agg(F.sum("late_rows")).first()[0] == 1
    partials = spark.read.parquet(f"{home}/partials")
    want = sessions(spark.read.parquet(source).where("NOT _closes AND NOT id <=> 901"), ["k"], "t", 20)
    assert table(stitch(partials, ["k"], 20)) == table(want) and want.count() > 20
    # a lane gives a session out once
    assert partials.agg(F.sum("n_events")).first()[0] == 300
