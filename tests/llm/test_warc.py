"""WARC round trips and verified boundaries."""

import hashlib

import pytest
from pyspark.sql import functions as F

from buzzscore.llm import warc
from buzzscore.llm.common import scratch, written

TRAP = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\n"


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit("x"))
    return written(df.repartition(1) if rows else df, "pages")


def write_and_read(spark, rows):
    path = scratch(spark, "warc-test")
    warc.write_archives(pages(spark, rows), path)
    return path, warc.read_archives(spark, path).collect()


def test_round_trip_with_magic_in_payloads(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # many splits, anywhere
    try:
        long_ = "é" * 400
        rows = [(i, f"http://a.example/{i}", f"<p>{i}</p>" * (i * 7 % 40)) for i in range(40)]
        rows += [
            (100, None, None),
            (101, "http://b.example/x\r\nX-Page-Id: 5", ""),
            (102, "http://b.example/ü", TRAP),
            (103, "http://b.example/2", "x" * 150 + TRAP * 3 + "tail"),
            (104, "u", "WARC/1.1\r\n"),
            (105, "u", "\r\n\r\n"),
            (106, "u", "a\r\n\r\nWARC/1.1\r\n\r\n\r\n" + TRAP[:-3]),
            (111, "u", long_),
            (110, "u", long_),
            (112, "u", long_),
            (None, "u", long_),
            (120, "u", "z" * 99),
            (121, "u", "z" * 99),
            (122, "u", "y" * 50_000 + TRAP),
        ]
        path, got = write_and_read(spark, rows)
        first = {}
        for id_, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            data = (html or "").encode()
            first.setdefault(data, id_)
        want = []
        for id_, _, html in rows:
            data = (html or "").encode()
            again = len(data) >= 100 and first[data] != id_
            want.append((id_, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
        key = lambda r: str(r)
        have = [
            (int(x["page"]) if x["page"] else None, x["payload_bytes"], x["payload_digest"], x["type"], int(x["refers_page"]) if x["type"] == "revisit" else None)
            for x in got
        ]
        assert sorted(have, key=key) == sorted(want, key=key)
        assert all(x["declared"] == "sha256:" + x["payload_digest"] for x in got)
        texts = sorted(bytes(x["payload"]) for x in warc.read_payloads(spark, path).collect())
        stored = [(h or "").encode() for i, _, h in rows if not (len((h or "").encode()) >= 100 and first[(h or "").encode()] != i)]
        assert texts == sorted(stored)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_the_chain_is_reachable(spark):
    links = [("f", 0, 10), ("f", 10, 25), ("f", 15, 25), ("f", 25, 99), ("f", 30, 40), ("g", 0, 7), ("g", 8, 20), ("h", 5, 9)]
    df = spark.createDataFrame(links, "file string, offset long, next long")
    got = sorted(tuple(r) for r in warc.reachable(df).collect())
    assert got == [("f", 0), ("f", 10), ("f", 25), ("g", 0)]


def test_long_chain_takes_few_rounds(spark):
    df = spark.range(1000).select(F.lit("f").alias("file"), (F.col("id") * 3).alias("offset"), (F.col("id") * 3 + 3).alias("next"))
    assert warc.reachable(df, rounds=12).count() == 1000


def test_empty_table(spark):
    assert write_and_read(spark, [])[1] == []


@pytest.mark.parametrize("same", [[3, 3, 1], [None, None]])
def test_equal_ids_are_records_of_their_own(spark, same):
    _, got = write_and_read(spark, [(i, "u", "q" * 200) for i in same])
    assert sorted(x["type"] for x in got) == ["response"] + ["revisit"] * (len(same) - 1)
