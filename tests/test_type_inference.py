"""Column types from all values."""

import itertools

import pytest

from buzzscore.schema import cast_losses
from buzzscore.sources.type_inference import account, cast_to, decide, kind_of, merge, read_inferred

KINDS = {
    None: None, "": "string", "true": "boolean", "FALSE": "boolean", "truth": "string",
    "0": "long", "-12": "long", "+7": "long", "007": "long", " 5 ": "long", "9223372036854775807": "long",
    "9223372036854775808": "double", "1.": "double", ".5": "double", "1e5": "double", "-2.5E-3": "double",
    ".": "string", "1e": "string", "12.5f": "string", "NaN": "string", "1_000": "string", "٣": "string",
    "2024-02-29": "date", "2023-02-29": "string", "2024-13-01": "string", "2024-1-1": "string",
    "2024-01-01 10:00": "timestamp", "2024-01-01T10:00:00Z": "timestamp", "2024-01-01 10:00:00.123456+02:00": "timestamp",
    "2024-01-01 25:00:00": "string", "x" * 100_000: "string", "1" * 65: "string", "1\n": "string", "1\n2": "string",
}


def test_kind_of_a_value(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(KINDS)], "i int, v string")
    got = {r.i: r.k for r in df.select("i", kind_of(df.v).alias("k")).collect()}
    for i, (value, kind) in enumerate(KINDS.items()):
        assert got[i] == kind, value and value[:30]


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def decided(spark, *values):
    return decide(account(frame(spark, *values))).first().asDict()


@pytest.mark.parametrize(
    "values, kind, why",
    [
        (["1", "2"], "long", None),
        (["1", "2.5", "3.5"], "double", "double x 2 (2.5)"),
        (["2024-01-01", "2024-01-01 10:00", None], "timestamp", "timestamp x 1 (2024-01-01 10:00)"),
        (["1", "true"], "string", "long x 1 (1)"),
        (["1", "2024-01-01"], "string", "date x 1 (2024-01-01)"),
        (["2024-01-01", "x"], "string", "string x 1 (x)"),
        ([None, None], "string", None),
    ],
)
def test_least_type(spark, values, kind, why):
    got = decided(spark, *values)
    assert (got["type"], got["rows"], got["widened_by"]) == (kind, len(values), why)
    assert got["nulls"] == values.count(None)


def test_merge_in_any_order_equals_one_account(spark):
    parts = [["1", "2"], ["2.5", None], ["9"]]
    whole = decided(spark, *sum(parts, []))
    for order in itertools.permutations(parts):
        merged = merge(*[account(frame(spark, *p)) for p in order])
        assert decide(merged).first().asDict() == whole
        nested = merge(merge(account(frame(spark, *order[0])), account(frame(spark, *order[1]))), account(frame(spark, *order[2])))
        assert decide(nested).first().asDict() == whole


def test_a_late_value_counts(spark):
    """The one value that widens the column is the last of many."""
    df = spark.range(20_000).selectExpr("CASE WHEN id = 19999 THEN 'late' ELSE CAST(id AS STRING) END AS c")
    got = decide(account(df)).first()
    assert (got["type"], got["widened_by"], got["rows"]) == ("string", "string x 1 (late)", 20_000)


def test_empty_and_odd_names(spark):
    assert decide(account(spark.createDataFrame([], "a string"))).first().asDict() == {
        "column": "a", "type": "string", "rows": 0, "nulls": 0, "widened_by": None,
    }
    odd = spark.createDataFrame([("1", "2024-01-01")], "`a.b` string, `c``d` string")
    rows = {r["column"]: r["type"] for r in decide(account(odd)).collect()}
    assert rows == {"a.b": "long", "c`d": "date"}
    assert [t for _, t in cast_to(odd, decide(account(odd))).dtypes] == ["bigint", "date"]


def test_read_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,x,when,text\n1,2.5,2024-01-01,"a\n""b"""\n 2 ,3,2024-01-02,\n,,,z\n')
    df, found = read_inferred(spark, str(tmp_path))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "when": "date", "text": "string"}
    assert sorted((r.n or 0, r.x or 0, r.text or "") for r in df.collect()) == [(0, 0, "z"), (1, 2.5, 'a\n"b"'), (2, 3.0, "")]
    later = account(spark.createDataFrame([("x",)], "n string"))
    assert {r["column"]: r["type"] for r in decide(merge(found, later)).collect()}["n"] == "string"


def test_cast_losses(spark):
    df = spark.createDataFrame(
        [("1", "t", "5"), ("x", "t", "5.5"), (None, None, None), ("2", "t", "1e30"), ("9", "t", "many")],
        "post_id string, date string, likes string",
    )
    got = {r["column"]: (r.present, r.lost, r.example) for r in cast_losses(df).collect()}
    assert got == {"post_id": (4, 1, "x"), "timestamp": (4, 0, None), "likes": (4, 3, "1e30")}
