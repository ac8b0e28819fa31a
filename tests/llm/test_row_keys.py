"""Rows meet again by their keys although the splits of the files change between jobs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from buzzscore.llm import common, jaccard_join, line_dedup, suffix_dedup, warc
from buzzscore.llm.common import scratch, with_place, written

CONF = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def moving(spark, monkeypatch):
    """From now on every written table changes the splits of what is read after it, as executors that come and go do."""
    sizes = itertools.cycle(["1500", "3000", "2200"])

    def then_move(df, name, write=common.written):
        out = write(df, name)
        spark.conf.set(CONF[0], next(sizes))
        return out

    spark.conf.set(CONF[1], "0")
    spark.conf.set(CONF[0], "100m")
    for module in (common, jaccard_join, suffix_dedup, warc, P):
        monkeypatch.setattr(module, "written", then_move)
    yield
    for name in CONF:
        spark.conf.unset(name)


def table(spark, texts, files=5):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return written(df.repartition(files, "doc_id"), "made")


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def near_texts():
    r, texts = random.Random(3), []
    for k in range(60):
        w = words(r, 60).split()
        for c in range(1 + k % 3):
            texts.append(" ".join([*w[: 30 + c], "changed" * c, *w[31 + c :]]))
    return texts


def test_similar_texts(spark, moving):
    texts = near_texts()
    got = jaccard_join.similar_texts(table(spark, texts)).collect()
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    want = [sum(10 * len(a & b) >= 8 * len(a | b) for b in sets) - 1 for a in sets]
    assert {x["id"]: x["n_links"] for x in got} == dict(enumerate(want))


def test_near_duplicates_of_the_pipeline(spark, moving):
    texts = near_texts()
    first = {t.split()[0]: i for i, t in reversed(list(enumerate(texts)))}
    left = P.drop_near_duplicates(spark, table(spark, texts), "").collect()
    assert sorted(x["doc_id"] for x in left) == sorted(first.values())


def test_repeated_strings(spark, moving):
    r = random.Random(4)
    texts, want = [], {}
    for i in range(60):
        shared, own = words(r, 100), words(r, 20)
        texts += [own + "|" + shared, shared + "|" + own[::-1]]
        want |= {2 * i: own + "|", 2 * i + 1: "|" + own[::-1]}
    got = suffix_dedup.dedup_substrings(table(spark, texts)).collect()
    assert {x["doc_id"]: bytes(x["kept"]).decode() for x in got} == want


def test_lines_meet_their_flags_in_a_written_table(spark):
    plan = line_dedup.dedup_lines(table(spark, ["a\nb\nc"] * 4))._jdf.queryExecution().executedPlan().toString()
    assert "monotonically_increasing_id" not in plan


def test_archives(spark, moving):
    r = random.Random(5)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\n"
    html = [words(r, 40) for _ in range(40)]
    html += [words(r, 30) + trap * (i % 3) + words(r, 3) + trap for i in range(40)]
    html += html[::2]
    path = scratch(spark, "warc-test")
    warc.write_archives(table(spark, html), path, id_col="doc_id", url_col="doc_id", html_col="text")
    got = {int(x["page"]): x for x in warc.read_archives(spark, path).collect()}
    sha = {i: x[0] for i, x in enumerate(spark.createDataFrame([(h,) for h in html], "h string").select(F.sha2("h", 256)).collect())}
    assert {i: x["payload_digest"] for i, x in got.items()} == sha
    assert {i for i, x in got.items() if x["type"] == "revisit"} == set(range(80, 120))
    stored = sorted(bytes(x["payload"]).decode() for x in warc.read_payloads(spark, path).collect())
    assert stored == sorted(html[:80])


def test_places_are_unique(spark, tmp_path):
    df = table(spark, ["x"] * 200)
    path = str(tmp_path / "t")
    df.write.parquet(path)
    cases = [df, df.where("doc_id > 3").select("text"), df.union(df), spark.read.parquet(path, path), df.crossJoin(spark.range(2))]
    cases += [df.select(F.explode(F.array("doc_id", "doc_id"))), df.withColumn("_metadata", F.lit(1)), spark.range(30).toDF("key")]
    for k, case in enumerate(cases):
        out = with_place(case)
        assert out.columns == [*case.columns, "rk"]
        assert out.select("rk").distinct().count() == out.count() == case.count(), k
    assert common._reads_parquet(cases[0]) and common._reads_parquet(cases[1])
    assert not any(map(common._reads_parquet, cases[2:]))
