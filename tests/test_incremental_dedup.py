"""Batches against a dedup of everything at once."""

import datetime as dt
import random

import pytest

from buzzscore.operators import incremental_dedup as D
from buzzscore.session import scratch_path

SCHEMA = "post_id long, content string, timestamp timestamp, extra string"


def batches(seed):
    r = random.Random(seed)
    texts = [None, "", "a", "b", *[f"text {i}" for i in range(60)]]
    days = [dt.datetime(2025, 1, d) for d in (1, 2)]
    ids = iter(range(10_000))
    return [[(next(ids), r.choice(texts), r.choice(days), f"x{k}") for _ in range(n)] for k, n in enumerate((80, 0, 50, 120))]


def first_of_all(all_):
    seen, out = set(), []
    for post in (p for batch in all_ for p in batch):
        if (post[1], post[2]) not in seen:
            seen.add((post[1], post[2]))
            out.append(post[0])
    return out


@pytest.mark.parametrize("bits", [8, 1 << 16])
def test_equals_a_dedup_of_all(spark, bits):
    """Filters of 8 bits are full at once: every key is a suspect, and the result is the same."""
    all_ = batches(bits)
    clean = D.CleanPosts(spark, scratch_path(spark, f"clean-{bits}"), SCHEMA, 4, bits)
    counts = [clean.add(k, spark.createDataFrame(b, SCHEMA)) for k, b in enumerate(all_)]
    assert sorted(r.post_id for r in clean.posts(4).collect()) == first_of_all(all_)
    assert clean.posts(4).columns == ["post_id", "content", "timestamp", "extra"]
    assert counts[0]["partitions_read"] == 0 or bits == 8
    # a batch that is run again gives the same
    clean.add(2, spark.createDataFrame(all_[2], SCHEMA))
    assert sorted(r.post_id for r in clean.posts(4).collect()) == first_of_all(all_)


def test_a_new_key_reads_nothing(spark):
    clean = D.CleanPosts(spark, scratch_path(spark, "clean-new"), SCHEMA, 4)
    day = dt.datetime(2025, 1, 1)
    clean.add(0, spark.createDataFrame([(1, "a", day, ""), (2, None, day, "")], SCHEMA))
    got = clean.add(1, spark.createDataFrame([(3, "new", day, "")], SCHEMA))
    assert got == {"posts": 1, "suspects": 0, "kept": 1, "partitions_read": 0}
    got = clean.add(2, spark.createDataFrame([(4, None, day, ""), (5, "a", day, "")], SCHEMA))
    assert got["suspects"] == 2 and got["kept"] == 0
