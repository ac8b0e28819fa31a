"""Spark splits the joins in which one key has most of the rows."""

import pytest
from pyspark.sql import functions as F

from buzzscore.llm import common, jaccard_join, line_dedup, warc
from buzzscore.llm.common import scratch, written

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def plans(spark, monkeypatch):
    """The final plans of what is written, by name."""
    found, was = {}, {k: spark.conf.get(k, None) for k in CONF}

    def and_show(df, name, write=common.written):
        df.collect()
        found[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    for k, v in CONF.items():
        spark.conf.set(k, v)
    for module in (common, jaccard_join, line_dedup, warc):
        monkeypatch.setattr(module, "written", and_show, raising=False)
    yield found
    for k, v in was.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_window_in_all_texts(spark, plans):
    docs = spark.range(0, 20_000, 1, 6).select(F.col("id").alias("rk"), "id", F.lit("a\nb\nc").alias("text"))
    out = line_dedup.repeated_windows(written(docs, "made"))
    assert len(out.collect()) == 19_999
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_a_payload_of_all_pages(spark, plans):
    pages = spark.range(0, 20_000, 1, 6).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 200).alias("html"))
    warc.write_archives(written(pages, "made"), scratch(spark, "warc-test"))
    assert "skew=true" in plans["revisits"]


def test_a_component_of_all_texts(spark, plans):
    number = F.concat(F.lit("w"), F.col("id").cast("string"))
    text = F.concat_ws(" ", *[F.lit(f"common{k}") for k in range(60)], number)
    docs = written(spark.range(0, 600, 1, 6).select(F.col("id").alias("doc_id"), text.alias("text")), "made")
    out = jaccard_join.similar_texts(docs)
    assert {(x["group_id"], x["n_links"]) for x in out.collect()} == {(0, 599)}
    assert "skew=true" in plans["members"]
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
