"""CSV with quoted line breaks, cut at every byte position, against Python's csv module."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buzzscore.sources.split_csv import HEAD, TAIL, WHOLE, _assemble, csv_records, read_split_csv


@pytest.fixture
def split_at(spark):
    """Set the size of splits; restored afterwards."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def set_(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield set_
    for k, v in before.items():
        spark.conf.set(k, v)


def sample(seed, n=40):
    r = random.Random(seed)
    field = lambda: r.choice(["", "x", 'say ""hi""'.replace('""', '"'), "two\nlines", "\n\n", 'q"\n"q', ",", "ünï\r\nçödé", "plain text", '"', "long " * 30 + "\n" * 5, " pad "])
    return [[str(i), field(), field()] for i in range(n)]


def written_csv(path, rows, header=("id", "a", "b"), ending="\n"):
    out = io.StringIO(newline="")
    w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=ending)
    w.writerow(header)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return out.getvalue().encode()


@pytest.mark.parametrize("size", [61, 500])
def test_records_at_any_split(spark, tmp_path, split_at, size):
    rows = sample(size, 25)
    written_csv(tmp_path / "in.csv", rows)
    split_at(4 * size)
    got = read_split_csv(spark, str(tmp_path / "in.csv"))
    assert got.columns == ["id", "a", "b"]
    assert sorted(([*x] for x in got.collect()), key=lambda x: int(x[0])) == [[f or None for f in x] for x in rows]


def assembled(data, borders, batch):
    """What the tasks and the join of fragments give if ``data`` is cut at ``borders``."""
    lines, at, inside, quotes = [], 0, [], 0
    for line in data.split(b"\n")[: -1 if data.endswith(b"\n") else None]:
        block = max([b for b in (0, *borders) if b < at or b == 0], default=0)  # a reader takes the lines after its first break
        if not lines or lines[-1][1] != block:
            inside += [block] if quotes % 2 else []
        lines.append((line.decode(), block))
        quotes += line.count(b'"')
        at += len(line) + 1
    schema = pa.schema([("value", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("split", pa.int64())])
    batches = [
        pa.RecordBatch.from_pylist([{"value": v, "file": "f", "block": b, "split": b} for v, b in lines[i : i + batch]], schema)
        for i in range(0, len(lines), batch)
    ]
    pieces = [r for out in _assemble(np.array(inside, np.int64))(iter(batches)) for r in out.to_pylist()]
    records, open_ = [], None
    for p in sorted(pieces, key=lambda p: (p["block"], p["seq"] if p["kind"] in (WHOLE, TAIL) else -1)):
        if p["kind"] == WHOLE:
            records.append(p["record"])
        elif p["kind"] == TAIL:
            open_ = [p["record"]]
        else:
            open_.append(p["record"])
            if p["kind"] == HEAD:
                records.append("\n".join(open_))
                open_ = None
    assert open_ is None
    return records


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_borders_at_every_byte(batch):
    """One border at each byte, and three borders anywhere: inside quotes, between doubled ones, at breaks."""
    data = b'a,b\n1,"x\ny"\n2,"""q""\n"\n"3\n","\n"\n4,"\n\n""\n"",\n"\n5,z\n'
    want = ["a,b", '1,"x\ny"', '2,"""q""\n"', '"3\n","\n"', '4,"\n\n""\n"",\n"', "5,z"]
    r = random.Random(batch)
    for at in range(len(data)):
        assert assembled(data, [at], batch) == want, at
    for _ in range(500):
        assert assembled(data, sorted(r.sample(range(len(data)), r.randint(2, 9))), batch) == want


def test_order_and_tasks(spark, tmp_path, split_at):
    rows = [[str(i), "x\n" * 20, "y"] for i in range(200)]
    written_csv(tmp_path / "in.csv", rows)
    split_at(1500)
    records = csv_records(spark, str(tmp_path / "in.csv"))
    ordered = [x.record.split('"')[1] for x in records.orderBy("file", "block", "seq").collect()]
    assert ordered == ["id", *[x[0] for x in rows]]
    assert records.select("block").distinct().count() > 5


def test_carriage_returns_headers_and_blank_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b'id,"na me"\r\n1,"x\r\ny"\r\n\r\n2,\r\n3,""\r\n')
    (folder / "b.csv").write_bytes(b'extra,id\ne,4')
    got = {x.id: (x["na me"], x.extra) for x in read_split_csv(spark, str(folder)).collect()}
    assert got == {"1": ("x\r\ny", None), "2": (None, None), "3": (None, None), "4": (None, "e")}
    (folder / "c.csv").write_bytes(b'id\n"5')
    with pytest.raises(ValueError, match="unbalanced"):
        read_split_csv(spark, str(folder))


def test_agrees_with_sparks_reader(spark, tmp_path, split_at):
    written_csv(tmp_path / "in.csv", sample(99, 300))
    split_at(2000)
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "in.csv"))
    got = read_split_csv(spark, str(tmp_path / "in.csv"))
    key = lambda df: sorted(tuple(x) for x in df.select(*[F.coalesce(c, F.lit("-null-")) for c in df.columns]).collect())
    assert key(got) == key(whole)


def test_empty_file(spark, tmp_path):
    (tmp_path / "in.csv").write_text("")
    assert read_split_csv(spark, str(tmp_path / "in.csv")).columns == []
    (tmp_path / "head.csv").write_text("a,b\n")
    got = read_split_csv(spark, str(tmp_path / "head.csv"))
    assert got.columns == ["a", "b"] and got.count() == 0
