"""Keep-first dedup of posts that arrive in batches, without reading all earlier posts again.

A folder holds the clean posts, partitioned by a hash of (content, timestamp),
and a Bloom filter of the same partitions: ``BITS`` bits for each, as one row.
For a batch:

1. its own repeats go (keep first);
2. keys meet the filter of their partition: one without all its bits set has
   never been seen, so its post is new;
3. the others, true repeats and a few false alarms, are compared exactly with
   the clean posts of just those partitions that they fall into;
4. new posts are added as the batch's folder, and the filters with the new
   keys' bits as its generation.

A batch that is run again reads the generations before it and overwrites its
own folders, so it may fail at any point.  A full filter costs reading, never
a wrong result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzscore.functions.pyhelpers import probe_filters
from buzzscore.operators.clean import dedup_posts
from buzzscore.session import written

#: Partitions of the clean table and of the filter.
PARTITIONS = 64
#: Bits of a partition's filter (128 KB); some ten for each post expected in it.
BITS = 1 << 20
KEY = ("content", "timestamp")


def _keyed(posts: DataFrame, partitions: int) -> DataFrame:
    """With ``_h1, _h2``, hashes of the key, and ``_p``, its partition; nulls are values of their own."""
    key = [x for c in KEY for x in (F.col(c), F.col(c).isNull())]
    out = posts.withColumns({"_h1": F.xxhash64(*key), "_h2": F.xxhash64(F.lit(1), *key)})
    return out.withColumn("_p", F.pmod("_h1", F.lit(partitions)).cast("int"))


class CleanPosts:
    """The clean posts of the batches so far, in the folder ``home`` on shared storage."""

    def __init__(self, spark: SparkSession, home: str, schema: str, partitions: int = PARTITIONS, bits: int = BITS):
        """``schema`` has the posts' columns as DDL; ``partitions`` and ``bits`` (a power of two) stay with the folder."""
        self.spark, self.home, self.schema = spark, home.rstrip("/"), schema
        self.partitions, self.bits = partitions, bits

    def _read(self, batches: Sequence[int]) -> DataFrame:
        kind = f"{self.schema}, _h1 long, _h2 long, _p int"
        if not batches:
            return self.spark.createDataFrame([], kind)
        reader = self.spark.read.schema(kind).option("basePath", f"{self.home}/clean")
        return reader.parquet(*[f"{self.home}/clean/batch={b}" for b in batches]).drop("batch")

    def posts(self, batches: int) -> DataFrame:
        """All clean posts of the first ``batches`` batches."""
        return self._read(range(batches)).drop("_h1", "_h2", "_p")

    def _filters(self, batch: int) -> DataFrame:
        kind = "_p int, bits binary"
        if not batch:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.home}/filter/batch={batch - 1}")

    def add(self, batch: int, posts: DataFrame, order_by: Sequence[str] = ("post_id",)) -> dict[str, int]:
        """Add batch number ``batch`` (0, 1, 2 ...); counts of what happened.

        Of equal posts the first batch's stays, within a batch the first by
        ``order_by``.  Null content equals null content.  A post without a
        timestamp is none that can be compared: leave such out before.
        """
        fresh = written(_keyed(dedup_posts(posts, order_by), self.partitions), "batch")
        keys = fresh.select("_p", "_h1", "_h2")
        probed = keys.groupBy("_p").cogroup(self._filters(batch).groupBy("_p"))
        probed = written(probed.applyInArrow(probe_filters(self.bits), "_p int, _h1 long, _h2 long, bits binary"), "probed")
        probed.where("bits IS NOT NULL").select("_p", "bits").write.mode("overwrite").parquet(f"{self.home}/filter/batch={batch}")

        maybe = probed.where("bits IS NULL").select("_p", "_h1", "_h2").distinct()
        touched = [r._p for r in maybe.select("_p").distinct().collect()]  # at most `partitions`
        earlier = self._read(range(batch)).where(F.col("_p").isin(touched)) if touched else self._read([])
        place = ["_p", "_h1", "_h2"]
        suspects = written(fresh.join(maybe, place, "left_semi"), "suspects")
        # only the touched partitions are read, and of them only posts with a suspect's hashes go on
        known = earlier.select(*place, *KEY).join(maybe, place, "left_semi")
        a, b = suspects.alias("a"), known.alias("b")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*place, *KEY)]
        settled = a.join(b, same, "left_anti")
        new = fresh.join(maybe, place, "left_anti").unionByName(settled)
        # hashes deal the posts out evenly: a file a partition
        new.repartition("_p").write.mode("overwrite").partitionBy("_p").parquet(f"{self.home}/clean/batch={batch}")
        kept = self._read([batch]).count()
        return {"posts": fresh.count(), "suspects": suspects.count(), "kept": kept, "partitions_read": len(touched)}


__all__ = ["CleanPosts", "PARTITIONS"]
