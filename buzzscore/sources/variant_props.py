"""Typed columns out of JSON text, with an account of what did not fit.

Every text is parsed once, to a variant; fields are taken from it by path and
type.  Nothing is dropped silently: texts that are no JSON are marked, and for
each row the fields are listed whose value is there but does not have the type.
All of it is built-in expressions in the row; the accounts are aggregates of a
row per field, or per key and kind.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of JSON values by the first word of Spark's name of a variant's type.
KINDS = {
    "VOID": "null", "BOOLEAN": "boolean", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number",
    "STRING": "text", "ARRAY": "list", "OBJECT": "object",
}


def shred(
    df: DataFrame, json_col: str, fields: Mapping[str, tuple[str, str]], malformed: str = "malformed", misfits: str = "misfits"
) -> DataFrame:
    """``df`` with a typed column for each field, ``malformed`` and ``misfits``.

    ``fields`` gives each column's path and type, as in
    ``{"likes": ("$.metrics.likes", "bigint")}``.  A value is converted if that
    loses nothing that Spark's cast of a variant knows of: ``"69"`` is a number, ``"n/a"`` is not.

    * Null where the path is absent, JSON null, or the value does not fit;
      in the last case ``misfits``, an array, has the column's name.
    * ``malformed`` holds for text that is no JSON, or too long for a variant, the empty text included
      (all its columns are null); a null text has no field and is not malformed.
    * Columns of ``df`` with the same names are an error.
    """
    new = [*fields, malformed, misfits]
    clash = set(new) & set(df.columns)
    if clash or len(set(new)) < len(new):
        raise ValueError(f"column names are taken: {sorted(clash) or new}")
    parsed = df.withColumn("_v", F.try_parse_json(F.col(f"`{json_col}`")))
    there = {name: _there(path) for name, (path, _) in fields.items()}
    typed = parsed.select("*", *[F.try_variant_get("_v", path, kind).alias(name) for name, (path, kind) in fields.items()])
    marks = [F.when(there[name] & F.col(f"`{name}`").isNull(), F.lit(name)) for name in fields]
    out = typed.withColumn(malformed, F.col(f"`{json_col}`").isNotNull() & F.col("_v").isNull())
    return out.withColumn(misfits, F.array_compact(F.array(*marks).cast("array<string>"))).drop("_v")


def _there(path: str) -> Column:
    value = F.try_variant_get("_v", path, "variant")
    return value.isNotNull() & ~F.is_variant_null(value)


def fit_account(shredded: DataFrame, fields: Mapping[str, tuple[str, str]], malformed: str = "malformed", misfits: str = "misfits") -> DataFrame:
    """``field, n_rows, n_malformed, n_fit, n_misfit`` of a table made by :func:`shred`: a row per field, one pass."""
    counts = [
        F.struct(
            F.lit(name).alias("field"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(malformed)).alias("n_malformed"),
            F.count(F.col(f"`{name}`")).alias("n_fit"),
            F.count_if(F.array_contains(misfits, name)).alias("n_misfit"),
        )
        for name in fields
    ]
    return shredded.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def key_kinds(df: DataFrame, json_col: str) -> DataFrame:
    """``key, kind, n``: how often each key of the top-level objects holds each kind of value.

    From every row, so that a schema is not guessed from the first ones.  Texts
    that are no object have no keys.
    """
    spark: SparkSession = df.sparkSession
    parsed = df.select(F.try_parse_json(F.col(f"`{json_col}`")).alias("v"))
    objects = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    each = objects.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    first_word = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return each.groupBy("key", F.coalesce(names[first_word], first_word).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
