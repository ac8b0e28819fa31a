"""What quality filters remove together and alone, kept up to date by a stream of files.

Five filters fail a document; which one is said to remove it depends on their
order.  The audit counts documents by part and by *mask*, the set of filters
they fail; every order's figures follow from these counters.

Four filters look at one text.  The fifth, "the same text has a smaller id", is
a fact about the whole table, and arriving files change it.  So the files are
read as a stream of micro-batches.  The state of a text is its smallest id so
far and what its holder counts as.  A smaller id that arrives later takes its
place: the counter change of the old holder's mask is retracted, and the same
document is counted again as a copy.  A micro-batch writes the sums of its
changes into a folder of its own number, so a batch that is run twice
overwrites itself; the sums of all folders are the counters.

Rows of one text are combined in each Arrow batch before the shuffle: of the
rows there only those of the smallest id can be the table's first, all others
are copies already.  A text that a third of all rows share costs a row per
Arrow batch.  Texts are kept by their digest, those of one range of digests as
one value of the state store, since a call of Python for each text would cost
more than all else; there is a range per ``RANGE_BYTES`` of input.  Which store
holds them is the session's choice
(``spark.sql.streaming.stateStore.providerClass``; RocksDB if some 70 bytes a
text are more than the executors' memory).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buzzscore.llm.common import let, scratch, written

# --- fixed values: the filters, in the order of their bits ---------------------
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
SPACE = "[ \t-\r]+"
SYMBOLS = r"[#$%&*|]"
# -------------------------------------------------------------------------------
COPY = 1 << FILTERS.index("E")
#: Micro-batches that the files of one run are dealt to, however many files there are.
BATCHES = 4
#: Input per range of digests: some thousand texts.
RANGE_BYTES = 8 << 20

_CHANGE = "range long, key binary, id long, part string, mask int, good boolean, toxic boolean, n long"
_COUNTER = "part string, mask int, good boolean, toxic boolean, n long"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text (not null) fails."""

    def of(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        few = F.when(n < MIN_WORDS, 1).otherwise(0)
        return few + F.when(distinct * 100 < n * MIN_DISTINCT_PERCENT, 2).otherwise(0)

    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    loud = F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS_PERCENT, 4).otherwise(0)
    return let(words, of) + loud + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def document_marks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``key`` (digest of the text), ``id, part, mask, good, toxic`` of each document; ``labels`` has a row per id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = docs.select(
        F.unhex(F.md5(text.cast("binary"))).alias("key"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"),
    )
    known = labels.select(F.col("id").alias("label_id"), "good", "toxic")
    joined = marks.join(known, F.col("id") == F.col("label_id"), "left")
    none = F.lit(False)
    return joined.select("key", "id", "part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


_FIELDS = [("key", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())]
_CLASS = ["part", "mask", "good", "toxic"]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks -> changes: candidates for a text's smallest id, and sums of what is settled, without an id.

    Settled are copies of a smaller id in the same batch, and rows without an id.
    """
    schema = pa.schema([("range", pa.int64()), *_FIELDS])
    for batch in batches:
        if not batch.num_rows:
            continue
        df = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        least = df.groupby("key")["id"].transform("min")
        copies = (df["id"] > least).fillna(False).to_numpy(bool)
        settled = copies | df["id"].isna().to_numpy(bool)
        df["mask"] = df["mask"].astype("int64") | np.where(copies, COPY, 0)
        done = df[settled].groupby(_CLASS, as_index=False).agg(range=("range", "min"), key=("key", "min"), n=("mask", "size"))
        done["id"] = pd.Series(pd.NA, index=done.index, dtype="Int64")
        first = df[~settled].groupby(["range", "key", "id", *_CLASS], as_index=False).size().rename(columns={"size": "n"})
        for part in (first, done):
            if len(part):
                yield pa.RecordBatch.from_pandas(part[schema.names], schema, preserve_index=False)


def merge(held: pa.Table, changes: pd.DataFrame) -> tuple[pa.Table, pd.DataFrame]:
    """The smallest ids' holders so far and new changes -> the holders after them, and the changes of the counters.

    Rows may share the smallest id (repeated rows): all of them are firsts, so
    there are as many holders as there are parts among them.
    """
    names = [f for f, _ in _FIELDS]
    settled = changes["id"].isna()
    new, old = changes.loc[~settled, names], held.to_pandas()
    rows = pd.concat([new, old], ignore_index=True) if len(old) else new.reset_index(drop=True)
    rows["id"] = rows["id"].astype("int64")
    first = (rows["id"] == rows.groupby("key")["id"].transform("min")).to_numpy(bool)
    known = np.arange(len(rows)) >= len(new)
    added = rows[~known].assign(mask=lambda d: d["mask"] | np.where(first[~known], 0, COPY))
    retracted = rows[known & ~first]
    copies = retracted.assign(mask=retracted["mask"] | COPY)
    counted = pd.concat([changes.loc[settled, names], added, retracted.assign(n=-retracted["n"]), copies])
    holders = rows[first].groupby(["key", "id", *_CLASS], as_index=False)["n"].sum()
    return pa.Table.from_pandas(holders[names], pa.schema(_FIELDS), preserve_index=False), counted.groupby(_CLASS, as_index=False)["n"].sum()


def _update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """:func:`merge` on the state of a range of digests."""
    held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else pa.schema(_FIELDS).empty_table()
    held, counted = merge(held, pd.concat(list(frames), ignore_index=True))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    state.update((sink.getvalue().to_pybytes(),))
    yield counted


def run_stream(
    spark: SparkSession,
    path: str,
    labels: DataFrame,
    home: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Process all files of the Parquet table at ``path`` that are new to ``home``; the counters so far.

    ``home`` is a folder on shared storage with the stream's checkpoint and its
    counter changes.  With the same folder a later call only reads the files
    added since, and its counters are those of one run over all files.  Without
    one, a new folder is taken.  ``labels`` has ``id, good, toxic``, one row per id.

    The counters are ``part, mask, good, toxic, n``, without those that are 0.
    """
    home = home or scratch(spark, "filter-audit")
    table = spark.read.parquet(path)
    docs = table.select(*dict.fromkeys([id_col, text_col, part_col]))
    files = table.select("_metadata.file_path", "_metadata.file_size").distinct()
    files, size = files.agg(F.count(F.lit(1)), F.sum("file_size")).first()
    changes = f"{home}/changes"
    counters = spark.createDataFrame([], _COUNTER)
    if files:
        ranges = _ranges(spark, home, max(1, -(-size // RANGE_BYTES)))
        # the last letter as a pattern: Spark lists a single file as a stream only by a pattern
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files_per_batch or -(-files // BATCHES))
        stream = stream.parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")
        marks = document_marks(stream, labels, id_col, text_col, part_col)
        marks = marks.select(F.pmod(F.xxhash64("key"), F.lit(ranges)).alias("range"), "*")
        changed = marks.mapInArrow(_combine, _CHANGE).groupBy("range").applyInPandasWithState(_update, _COUNTER, "holders binary", "append", "NoTimeout")

        def add(batch: DataFrame, number: int) -> None:
            sums = batch.groupBy(*_CLASS).agg(F.sum("n").alias("n")).where("n <> 0")
            sums.write.mode("overwrite").parquet(f"{changes}/batch={number}")

        query = changed.writeStream.foreachBatch(add).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        counters = spark.read.schema(_COUNTER).option("recursiveFileLookup", True).parquet(changes)
    return counters.groupBy(*_CLASS).agg(F.sum("n").alias("n")).where("n <> 0")


def _ranges(spark: SparkSession, home: str, wanted: int) -> int:
    """The number of ranges of digests: that of the first call with ``home``, since its state goes by it."""
    path = f"{home}/ranges"
    if not _exists(spark, path):
        spark.range(wanted, wanted + 1).coalesce(1).write.parquet(path)
    return spark.read.parquet(path).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def interactions(counters: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, from the counters of the masks.

    One row per part, order and step, zeros included: ``kept`` after the step,
    ``removed`` there, ``redundant`` (failing the step's filter, gone before),
    ``unique_fails`` (failing that filter only), ``good_lost`` and
    ``toxic_lost`` of the removed, and ``shapley``, what the filter removes in
    all orders together.  A counter becomes 600 rows, whatever the table's size.
    """
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    orders = F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order")
    rows = counters.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    rows = rows.withColumns({"bit": bits(F.col("filter")), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    mask = F.col("mask")
    fails, gone = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("before")) != 0
    count = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    steps = rows.groupBy("part", "filter_order", "step", "filter").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(mask == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone & F.col("good")).alias("good_lost"),
        count(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(spark: SparkSession, path: str, labels: DataFrame, home: str | None = None, **columns) -> DataFrame:
    """The filter interactions of the Parquet table at ``path``; ``labels`` has ``doc_id, quality, toxic``.

    A document fails A with fewer than 200 words, B if fewer than half of its
    words are distinct, C if more than 3 % of its characters are capitals A-Z,
    D with a character of ``#$%&*|``, and E if a smaller id has the same text.

    * A null text counts as empty; a null part as the part with the empty name.
    * A row without an id never fails E, and makes no other row fail it.
    * Rows of the same id and text are no copies of each other.
    * A document with several label rows is good or toxic if one of them says so.
    * Texts of any length are read whole; a table without rows gives none.
    * Other columns of the table are not read, so their names do not matter.
    """
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = one.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return interactions(run_stream(spark, path, written(known, "labels"), home, **columns))
