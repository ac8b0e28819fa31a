"""Helpers that the operators share: tables, row keys, scratch tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzscore.session import checkpoint_dir

# Words are runs of characters other than these; the class means the same in
# Java's regular expressions, RE2 and Python.
BLANK = r"[ \t\n\r\f]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_key(df: DataFrame, name: str = "rk") -> DataFrame:
    """Add a unique row key, in the order of the rows as read.

    The key is ``monotonically_increasing_id()``: a function of the input split
    and the position in it.  Splits depend on the cores that are there when a
    job is planned, so the key holds within one job only: use :func:`keyed`
    where rows meet again by it.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def keyed(df: DataFrame, name: str = "rk") -> DataFrame:
    """``df`` with :func:`with_row_key`, written once: every job that reads it finds a row under the same key."""
    return written(with_row_key(df, name), "keyed")


def with_place(df: DataFrame, name: str = "rk") -> DataFrame:
    """Add a unique ``struct<file, row>`` that holds in all jobs, without a copy where it can.

    It is the row's file and its number in it if ``df`` reads one Parquet path
    by projections and filters only, else the key of a written copy.
    """
    if _reads_parquet(df):
        return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    key = fresh(df, "key")
    copy = keyed(df, key)
    return copy.withColumn(name, F.struct(F.lit("").alias("file"), F.col(key).alias("row"))).drop(key)


def _reads_parquet(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of the files below one path."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if any(node.output().apply(i).name().lower() == "_metadata" for i in range(node.output().size())):
            return False
        node = node.children().apply(0)
    if node.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = node.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return False
    # a path given twice is read twice
    return relation.location().rootPaths().size() == 1 and "_metadata" not in {c.lower() for c in relation.schema().fieldNames()}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: later steps survive lost executors without
    computing ``df`` again, and a column is decoded only where it is used.
    The table stays until :func:`drop_scratch`, since a lazy result may read it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[str] = []


def scratch_mark() -> int:
    """The number of written tables so far: where a job's own begin."""
    return len(_SCRATCH)


def drop_scratch(spark: SparkSession, begin: int = 0, end: int | None = None) -> None:
    """Delete the written tables of earlier calls, or those from ``begin`` (a :func:`scratch_mark`) up to ``end``;
    their results must be stored by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _SCRATCH[begin:end]
    del _SCRATCH[begin:end]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def words(text: Column) -> Column:
    """Lower-cased words between blanks; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK + "+", -1), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """The words' 64-bit hashes, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's variable is not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``(id, component)`` of an undirected graph given as edges ``(a, b)``.

    The component is its smallest id.  Each round maps every vertex to the
    smallest of itself and its neighbours, then to what that one is mapped to
    (pointer jumping), and contracts the graph: edges go between the vertices
    mapped to, those within one disappear.  A star is done in one round.  Minima
    are combined before each shuffle and joins are free to split a hub; the
    tables of each round are written.
    """
    graph = written(edges.select("a", "b").distinct(), "edges")
    found: DataFrame | None = None
    for _ in range(rounds):
        both = graph.union(graph.select("b", "a"))
        least = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to"))
        least = written(least, "labels")
        roots = least.select(F.col("id").alias("to"), F.col("to").alias("root"))
        jumped = written(least.join(roots, "to").select("id", F.col("root").alias("to")), "labels")
        if found is None:
            found = jumped.select("id", F.col("to").alias("component"))
        else:
            onward = jumped.select(F.col("id").alias("component"), "to")
            found = found.join(onward, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            found = written(found, "components")
        for end in ("a", "b"):
            graph = graph.join(jumped.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to")), end)
        graph = written(graph.where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "edges")
        if graph.isEmpty():
            return found
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches, cut so that no group of equal ``keys`` first columns is divided; and the group starts."""
    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, table]) if rest is not None else table
        new = np.zeros(len(rest), bool)
        new[0] = True
        for k in range(keys):
            column = rest.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield rest.slice(0, starts[-1]).combine_chunks().to_batches()[0], starts[:-1]
            rest = rest.slice(starts[-1])
    if rest is not None:
        yield rest.combine_chunks().to_batches()[0], np.flatnonzero(np.arange(len(rest)) == 0)
