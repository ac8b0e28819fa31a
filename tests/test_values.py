"""Timestamp parsing and numeric coercion."""

import datetime as dt

from pyspark.sql import functions as F

from buzzscore.functions.values import parse_timestamp, to_double_or_zero


def test_timestamp_variants(spark):
    cases = [
        ("2025-09-01 10:00:00", dt.datetime(2025, 9, 1, 10, 0)),
        ("2025-09-01", dt.datetime(2025, 9, 1)),
        ("2025-09-01T10:00:00Z", dt.datetime(2025, 9, 1, 10, 0)),
        ("2025-09-01T10:00:00+05:30", dt.datetime(2025, 9, 1, 4, 30)),
        ("2025-09-01 10:00:00.123456", dt.datetime(2025, 9, 1, 10, 0, 0, 123456)),
        ("01/09/2025", dt.datetime(2025, 1, 9)),
        ("Sep 1, 2025", dt.datetime(2025, 9, 1)),
        ("12:30:00", None),
        ("2025", None),
        ("garbage", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    out = df.select("i", parse_timestamp(F.col("s")).cast("timestamp_ntz").alias("t")).orderBy("i")
    got = [r["t"] for r in out.collect()]
    assert got == [want for _, want in cases]


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("12",), ("12.5f",), ("NaN",), (None,), (" 3.5 ",), ("1e2",)], "s string")
    got = [r[0] for r in df.select(to_double_or_zero(F.col("s"))).collect()]
    assert got == [12.0, 0.0, 0.0, 0.0, 3.5, 100.0]
