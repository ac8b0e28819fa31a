"""Quoted CSV with line breaks in its fields, read from any number of splits.

Spark's own reader takes such a file in one task, since a line break says
nothing about whether a record ends there.  What decides is whether the number
of quotes before it is even: inside a field quotes are doubled.

1. The physical lines of each split are read in parallel and their quotes
   counted: a row per split.
2. A prefix sum of these parities over the splits of a file says which splits
   begin inside a field.
3. The splits are read again.  With its parity known, each task puts lines
   together to records.  Lines before the first record that starts in a split,
   and a record that does not end in it, are fragments.
4. Fragments, at most two a split, are joined along the splits of their file.

Records are written once to the shared folder, so no text is shuffled but that
of the fragments, and parsed with ``from_csv``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buzzscore.session import written

#: Different headers that the files of one input may have.
MAX_HEADERS = 100
#: Splits that may begin inside a field: 8 bytes each go to the tasks.
MAX_INSIDE = 4_000_000

_RECORD = "file string, block long, seq long, kind int, record string"
WHOLE, HEAD, THROUGH, TAIL = range(4)  # kinds of records and fragments, in their order within a split


class _same_splits:
    """Jobs inside divide files alike, whatever cores there are when one is planned."""

    KEY = "spark.sql.files.minPartitionNum"

    def __init__(self, spark: SparkSession):
        self.spark, self.conf = spark, spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY, None)
        if self.before is None:
            self.conf.set(self.KEY, str(self.spark.sparkContext.defaultParallelism))

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(self.KEY)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _split_key() -> Column:
    return F.xxhash64("file", "block").alias("split")


def split_parities(lines: DataFrame) -> DataFrame:
    """``file, block, split, inside``: whether a split begins inside a quoted field.

    A file with an odd number of quotes cannot be divided into records: an error.
    """
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    counts = written(lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")), "quotes")
    odd = counts.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").select("file").first()
    if odd:
        raise ValueError(f"unbalanced quotes in {odd.file}")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    before = F.coalesce(F.sum("quotes").over(earlier), F.lit(0))
    return counts.select("file", "block", _split_key(), (before % 2 == 1).alias("inside"))


def _assemble(inside: np.ndarray):
    """Lines of splits, in order -> records and fragments; ``inside`` has the keys of splits that begin in a field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: tuple | None = None
        parity = seq = 0
        open_: list[str] = []  # lines of the record that has not ended
        started = True  # in this split

        def unfinished() -> list[tuple]:
            if not open_:
                return []
            kind = TAIL if started else THROUGH
            return [(*split[:2], seq, kind, "\n".join(open_))]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            names = [c.split()[0] for c in _RECORD.split(", ")]
            return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

        for batch in batches:
            out: list[tuple] = []
            files, blocks, keys = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
            quotes = pc.count_substring(batch.column(0), '"').to_numpy(zero_copy_only=False)
            for begin, end in zip(new, np.append(new[1:], len(keys)), strict=True):
                if split is None or split[2] != keys[begin]:
                    out += unfinished()
                    split = (files[begin].as_py(), int(blocks[begin]), int(keys[begin]))
                    at = np.searchsorted(inside, split[2])
                    parity = int(at < len(inside) and inside[at] == split[2])
                    open_, seq, started = [], 0, parity == 0
                upto = parity + np.cumsum(quotes[begin:end])
                lines, last = batch.column(0).slice(begin, end - begin).to_pylist(), 0
                for stop in (np.flatnonzero(upto % 2 == 0) + 1).tolist():
                    record = "\n".join([*open_, *lines[last:stop]])
                    out.append((*split[:2], seq, WHOLE if started else HEAD, record))
                    open_, last, seq, started = [], stop, seq + 1, True
                open_ += lines[last:]
                parity = int(upto[-1] % 2)
            if out:
                yield batch_of(out)
        if rows := (unfinished() if split else []):
            yield batch_of(rows)

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """Fragments -> records: each starts with a tail and ends with the next head of its file."""
    order = Window.partitionBy("file").orderBy("block", "kind", "seq")  # two rows a split at most
    runs = pieces.withColumn("run", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "seq", "record")))
    whole = runs.groupBy("file", "run").agg(parts.alias("parts"))
    first = F.element_at("parts", 1)
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return whole.select("file", first["block"].alias("block"), first["seq"].alias("seq"), text.alias("record"))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, seq, record``: the records of CSV files as text, in the order of the three columns.

    ``block`` is where the split begins that a record starts in, ``seq`` its
    number there.  Blank records are kept; a carriage return at a record's end
    belongs to the line break.
    """
    with _same_splits(spark):
        parities = written(split_parities(_lines(spark, path)), "parities")
        count = parities.where("inside").count()
        if count > MAX_INSIDE:
            raise ValueError(f"{count} splits begin inside a field; raise spark.sql.files.maxPartitionBytes")
        inside = np.sort(np.array([r.split for r in parities.where("inside").select("split").collect()], np.int64))
        lines = _lines(spark, path).select("value", "file", "block", _split_key())
        pieces = written(lines.mapInArrow(_assemble(inside), _RECORD), "records")
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "seq", "record")
    records = whole.unionByName(_joined(pieces.where(F.col("kind") != WHOLE)))
    return records.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_split_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with a header, as text columns; quoted fields may hold line breaks and doubled quotes.

    Files may have their columns in different orders or lack some, which are
    null there.  An empty field is null, quoted or not, as Spark reads it.
    Records of too many or too few fields are read as Spark does.  Quotes must
    be in quoted fields only.  An input without any record has no columns.
    """
    records = csv_records(spark, path)
    is_header = (F.col("block") == 0) & (F.col("seq") == 0)
    heads = written(records.where(is_header).select("file", F.col("record").alias("header")), "headers")
    headers = [r.header for r in heads.select("header").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(headers) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    rows = records.where(~is_header & (F.trim("record") != "")).join(heads, "file")
    parts = []
    for header in sorted(headers):
        names = _names(spark, header, options)
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        fields = F.from_csv("record", F.lit(schema), options)
        part = rows.where(F.col("header") == header) if len(headers) > 1 else rows
        parts.append(part.select(fields.alias("row")).select("row.*"))
    if not parts:
        return spark.createDataFrame([], "struct<>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _names(spark: SparkSession, header: str, options: dict[str, str]) -> list[str]:
    """The column names of a header line, by the same parser; empty and repeated ones get their number."""
    width = header.count(",") + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    row = spark.range(1).select(F.from_csv(F.lit(header), F.lit(schema), options).alias("r")).first().r
    names = [x for x in row]
    while len(names) > 1 and names[-1] is None and width > len(names):
        names.pop()
    seen = [n for n in names if n is not None]
    used = names[: max((i for i, n in enumerate(names) if n is not None), default=-1) + 1]
    return [n if n and seen.count(n) == 1 else f"{n or '_c'}{i}" for i, n in enumerate(used)]
