"""Fields of JSON text: what fits, what does not, what is no JSON."""

import pytest

from buzzscore.sources.variant_props import fit_account, key_kinds, shred

FIELDS = {"likes": ("$.m.likes", "bigint"), "score": ("$.score", "double"), "tags": ("$.tags", "array<string>")}
TEXTS = [
    '{"m": {"likes": 3}, "score": 1.5, "tags": ["a", "b"]}',
    '{"m": {"likes": "12"}, "score": 2, "tags": []}',
    '{"m": {"likes": "n/a"}, "score": "x", "tags": "a"}',
    '{"m": {"likes": null}, "score": null}',
    '{"m": 5, "score": true}',
    "[1, 2]",
    "7",
    '{"score": 1',
    "",
    None,
    '{"score": 99999999999999999999999, "m": {"likes": 99999999999999999999999}, "pad": "' + "x" * 500_000 + '"}',
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id int, props string")


def test_shred(table):
    got = {r.id: r for r in shred(table, "props", FIELDS).collect()}
    assert (got[0].likes, got[0].score, got[0].tags, got[0].misfits) == (3, 1.5, ["a", "b"], [])
    assert (got[1].likes, got[1].score, got[1].tags, got[1].misfits) == (12, 2.0, [], [])
    assert (got[2].likes, got[2].score, got[2].tags) == (None, None, None)
    assert sorted(got[2].misfits) == ["likes", "score", "tags"]
    assert got[3].misfits == [] and got[3].likes is None
    assert got[4].likes is None and "likes" not in got[4].misfits
    assert [i for i in got if got[i].malformed] == [7, 8]
    assert got[9].malformed is False and got[9].misfits == []
    assert got[10].misfits == ["likes"] and got[10].score == pytest.approx(1e23)


def test_accounts(table):
    shredded = shred(table, "props", FIELDS)
    got = {r.field: (r.n_rows, r.n_malformed, r.n_fit, r.n_misfit) for r in fit_account(shredded, FIELDS).collect()}
    assert got["likes"] == (11, 2, 2, 2) and got["tags"] == (11, 2, 2, 1)
    kinds = {(r.key, r.kind): r.n for r in key_kinds(table, "props").collect()}
    assert kinds[("m", "object")] == 5 and kinds[("m", "number")] == 1
    assert kinds[("score", "null")] == 1 and kinds[("score", "text")] == 1 and kinds[("score", "boolean")] == 1
    assert kinds[("score", "number")] == 3 and kinds[("tags", "list")] == 2 and kinds[("pad", "text")] == 1


def test_empty_and_clashes(spark, table):
    none = table.limit(0)
    assert [tuple(r)[1:] for r in fit_account(shred(none, "props", FIELDS), FIELDS).collect()] == [(0, 0, 0, 0)] * 3
    assert key_kinds(none, "props").count() == 0
    with pytest.raises(ValueError):
        shred(table.withColumnRenamed("id", "likes"), "props", FIELDS)
