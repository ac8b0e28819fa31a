"""Components and group boundaries."""

import random

import numpy as np
import pyarrow as pa

import pytest

from buzzscore.llm.common import connected_components, drop_scratch, scratch, scratch_mark, sorted_groups, written


def test_components_of_paths_stars_and_random_edges(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7)]
    edges += [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["id"]: x["component"] for x in got} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_are_never_divided():
    keys = np.sort(np.random.default_rng(0).integers(0, 30, 500))
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 7], "v": np.arange(len(keys[i : i + 7])) + i}) for i in range(0, 500, 7)]
    seen = []
    for batch, starts in sorted_groups(iter(batches), 1):
        k = batch.column(0).to_numpy()
        assert k[starts].tolist() == np.unique(k).tolist()
        seen += batch.column(1).to_pylist()
        assert not set(k.tolist()) & {keys[i] for i in range(500) if i not in range(seen[0], seen[-1] + 1)}
    assert seen == list(range(500))


def test_scratch_tables_go(spark, tmp_path):
    df = written(spark.range(3), "some")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    import os

    assert os.path.isdir(path) and scratch(spark, "a") != scratch(spark, "a")
    assert df.count() == 3
    drop_scratch(spark)
    assert not os.path.exists(path)


def test_drop_scratch_of_one_job(spark):
    before = written(spark.range(3), "before")
    mark = scratch_mark()
    inner, last = written(spark.range(4), "inner"), written(spark.range(5), "last")
    drop_scratch(spark, mark, -1)
    assert (before.count(), last.count(), scratch_mark()) == (3, 5, mark + 1)
    with pytest.raises(Exception, match="(?i)not.exist"):
        inner.count()
