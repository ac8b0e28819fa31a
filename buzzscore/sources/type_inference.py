"""Column types of text data, found from every value, not from the first rows.

A value has the narrowest kind that its spelling allows; a column has the
least type that holds all its kinds:

    boolean   long < double   date < timestamp        all of them < string

Least upper bounds are commutative and associative, so a column's kinds with
their counts (its *account*) merge in any order: over tasks, over files, and
over days, without reading earlier files again.  For each kind the account
keeps the smallest value of it, which says what widened a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzscore.sources.split_csv import read_split_csv

# --- fixed values -----------------------------------------------------------
# Kinds of values, narrower ones first.
KINDS = ("boolean", "long", "double", "date", "timestamp", "string")
BOOLEAN = r"^(?i:true|false)\z"
WHOLE = r"^[+-]?[0-9]+\z"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?\z"
# ---------------------------------------------------------------------------

#: Longer values are text; so a long text is never matched against a pattern.
MAX_LENGTH = 64
#: An example of a kind is shown up to this length.
EXAMPLE = 40
ACCOUNT = "column string, kind string, n long, example string"


def kind_of(value: Column) -> Column:
    """The kind of one value; null for a missing one.  Spaces around it do not count.

    Whole numbers beyond 64 bits are doubles; a day or time that no calendar has is a string.
    """
    v = F.trim(value)
    found = (
        F.when(F.length(v) > MAX_LENGTH, "string")
        .when(v.rlike(WHOLE), F.when(v.try_cast("bigint").isNotNull(), "long").otherwise("double"))
        .when(v.rlike(NUMBER), "double")
        .when(v.rlike(BOOLEAN), "boolean")
        .when(v.rlike(DAY), F.when(v.try_cast("date").isNotNull(), "date").otherwise("string"))
        .when(v.rlike(TIME), F.when(v.try_cast("timestamp").isNotNull(), "timestamp").otherwise("string"))
        .otherwise("string")
    )
    return F.when(value.isNotNull(), found)


def account(df: DataFrame) -> DataFrame:
    """``(column, kind, n, example)`` of a frame of text columns, kind ``null`` for missing values.

    One aggregation without a key: a task sends one row, whatever it read.  A
    kind that no value has is left out; a column of an empty frame has one row
    of kind ``null`` and ``n`` 0.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], ACCOUNT)
    values, kinds = [f"v{i}" for i in range(len(df.columns))], [f"k{i}" for i in range(len(df.columns))]
    typed = df.toDF(*values)
    typed = typed.select(
        *[kind_of(F.col(v)).alias(k) for v, k in zip(values, kinds)],
        *[F.substring(F.trim(v), 1, EXAMPLE).alias(v) for v in values],
    )
    aggs = []
    for v, k in zip(values, kinds):
        for kind in KINDS:
            aggs.append(F.count_if(F.col(k) == kind).alias(f"{k}_{kind}"))
            aggs.append(F.min(F.when(F.col(k) == kind, F.col(v))).alias(f"{v}_{kind}"))
        aggs.append(F.count_if(F.col(k).isNull()).alias(f"{k}_null"))
    cells = []
    for name, v, k in zip(df.columns, values, kinds):
        missing = (F.lit("null"), F.col(f"{k}_null"), F.lit(None).cast("string"))
        found = [(F.lit(kind), F.col(f"{k}_{kind}"), F.col(f"{v}_{kind}")) for kind in KINDS]
        for kind, n, example in (missing, *found):
            cells.append(F.struct(F.lit(name).alias("column"), kind.alias("kind"), n.alias("n"), example.alias("example")))
    rows = typed.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rows.where("n > 0 OR kind = 'null'")


def merge(*accounts: DataFrame) -> DataFrame:
    """One account of several; the order does not matter."""
    if not accounts:
        raise ValueError("no accounts")
    rows = reduce(DataFrame.unionByName, accounts)
    return rows.groupBy("column", "kind").agg(F.sum("n").alias("n"), F.min("example").alias("example"))


def decide(accounts: DataFrame) -> DataFrame:
    """``(column, type, rows, nulls, widened_by)`` of an account.

    ``widened_by`` names, narrower first, each kind but the narrowest that the
    column holds, as ``kind x count (smallest value)``; null where one kind is
    all.  A column without a value is a string.
    """
    has = {k: F.bool_or(F.col("kind") == k) for k in KINDS}
    number, moment = has["long"] | has["double"], has["date"] | has["timestamp"]
    families = has["boolean"].cast("int") + number.cast("int") + moment.cast("int")
    least = (
        F.when(has["string"] | (families != 1), "string")
        .when(has["boolean"], "boolean")
        .when(number, F.when(has["double"], "double").otherwise("long"))
        .otherwise(F.when(has["timestamp"], "timestamp").otherwise("date"))
    )
    place = reduce(lambda c, i: c.when(F.col("kind") == KINDS[i], i), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    text = F.concat("kind", F.lit(" x "), F.col("n").cast("string"), F.lit(" ("), "example", F.lit(")"))
    kinds = F.array_sort(F.collect_list(F.when((F.col("kind") != "null") & (F.col("n") > 0), F.struct(place.alias("p"), text.alias("t")))))
    reasons = F.slice(kinds["t"], 2, len(KINDS))
    return merge(accounts).groupBy("column").agg(
        least.alias("type"),
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("nulls"),
        F.when(F.size(kinds) > 1, F.array_join(reasons, ", ")).alias("widened_by"),
    )


def cast_to(df: DataFrame, decided: DataFrame) -> DataFrame:
    """``df`` with its text columns cast to the decided types; columns without a decision stay."""
    types = {r["column"]: r["type"] for r in decided.select("column", "type").collect()}  # a row per column
    cols = []
    for c in df.columns:
        col = F.col("`" + c.replace("`", "``") + "`")
        kind = types.get(c, "string")
        cols.append((col if kind == "string" else F.trim(col).try_cast("bigint" if kind == "long" else kind)).alias(c))
    return df.select(*cols)


def read_inferred(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Quoted CSV in any number of splits with its columns typed, and the account they were decided from.

    Keep the account: ``decide(merge(kept, account(new)))`` says whether new files widen a type.
    """
    text = read_split_csv(spark, path)
    found = spark.createDataFrame(account(text).collect(), ACCOUNT)  # at most seven rows a column
    return cast_to(text, decide(found)), found
