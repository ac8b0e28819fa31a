"""Mixing sources to target weights, by a tree of domain, language and source.

A token budget goes down the tree.  At each node it is shared among the
children by weight; a child takes no more than it can give (its tokens times
the number of epochs allowed), and what it leaves goes to its siblings by
weight.  A node's capacity is the sum of its children's, so a shortage reaches
an ancestor's siblings only when all siblings below are used up.

A leaf's share is spent on whole epochs first, then on a prefix of one more
epoch in that epoch's seeded order.  The order is split into buckets by its
leading digits: bucket sums find the bucket in which a leaf's share ends, and
only that bucket's rows are put in order.  What goes back to the rows is one
cut key per leaf.  All amounts are integers (decimals), so the shares do not
depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buzzscore.llm.common import fresh, words, written

#: Leading hex digits of the seeded order that make a bucket: 4,096 buckets per leaf.
BUCKET_DIGITS = 3


def _share(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Share each parent's ``budget`` among its children: adds ``granted``.

    ``children`` has the parent's columns, ``weight, capacity, budget``.  Taken
    in the order of capacity per weight, a child is used up if its fair part of
    what the earlier ones leave is no less than its capacity; the first that is
    not, and all after it, share the rest by weight, rounded down.
    """
    per = F.col("capacity").cast("double") / F.col("weight")
    everyone = Window.partitionBy(*parent)
    order = everyone.orderBy(per, *[c for c in children.columns if c not in _AMOUNTS])
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = children.withColumns({"before": before, "left": left})
    used_up = F.expr("CAST(capacity AS decimal(20,0)) * left <= CAST(weight AS decimal(18,0)) * (budget - before)")
    out = out.withColumn("used_up", used_up)
    out = out.withColumns(
        {
            "rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("used_up"), F.col("capacity"))).over(everyone), F.lit(0)),
            "left": F.sum(F.when(~F.col("used_up"), F.col("weight"))).over(everyone),
        }
    )
    fair = F.expr("CAST(weight AS decimal(18,0)) * CAST(rest AS decimal(20,0)) div left")
    return out.withColumn("granted", F.when(F.col("used_up"), F.col("capacity")).otherwise(fair)).drop(
        "before", "rest", "left", "used_up"
    )


_AMOUNTS = ("weight", "capacity", "budget", "tokens")


def leaf_budgets(
    leaves: DataFrame, total: int, epochs: int, domains: dict[str, int], langs: dict[str, int], other: int = 1
) -> DataFrame:
    """``(domain, lang, source, tokens, granted)`` of leaves ``(domain, lang, source, tokens)``.

    Weights are integers; a domain or language without one has ``other``, and
    the sources of a language have the same weight.
    """

    def weight(name: str, table: dict[str, int]) -> Column:
        out = F.lit(other)
        for key, value in table.items():
            out = F.when(F.col(name) == key, value).otherwise(out)
        return out

    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    top = by_domain.withColumns({"root": F.lit(0), "weight": weight("domain", domains), "budget": F.lit(total)})
    top = _share(top, ["root"]).select("domain", F.col("granted").alias("budget"))
    mid = by_lang.join(top, "domain").withColumn("weight", weight("lang", langs))
    mid = _share(mid, ["domain"]).select("domain", "lang", F.col("granted").alias("budget"))
    low = leaves.join(mid, ["domain", "lang"]).withColumn("weight", F.lit(1))
    return _share(low, ["domain", "lang"]).select("domain", "lang", "source", "tokens", "granted")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    domain: Column,
    domains: dict[str, int],
    langs: dict[str, int],
    total: int | None = None,
    share: float = 0.5,
    epochs: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """A row per document and epoch taken: the columns of ``docs``, and ``domain, tokens, epoch``.

    ``total`` tokens are to be spent; null: ``share`` of all tokens.  Tokens are
    the words between blanks.

    * A null domain, language or source is the leaf ``(none)``; a null or blank
      text has no tokens and is taken with each epoch that reaches its place; a
      leaf without any tokens gives nothing.
    * Rows with equal ids (or null ids) share one place in the order and are
      taken or left together; a leaf never gets more than its share.
    * An empty table gives an empty result.
    * A text of any length is one place with all its tokens; only their number
      leaves the row.
    * Columns of ``docs`` that have a result's name are kept; the result then
      carries underscores in front.
    """
    none = F.lit("(none)")
    n = {k: fresh(docs, k) for k in ("domain", "tokens", "epoch")}
    leaf = {
        "l_domain": F.coalesce(domain.cast("string"), none),
        "l_lang": F.coalesce(F.col(lang_col), none),
        "l_source": F.coalesce(F.col(source_col), none),
    }
    tokens = F.size(words(F.col(text_col))).cast("long")
    narrow = written(
        docs.select(*[v.alias(k[2:]) for k, v in leaf.items()], F.col(id_col).alias("id"), tokens.alias("tokens")),
        "tokens",
    )
    leaves = narrow.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"))
    if total is None:
        everything = narrow.agg(F.sum("tokens")).first()[0] or 0
        total = int(everything * share)
    key = ["domain", "lang", "source"]
    plan = leaf_budgets(leaves, total, epochs, domains, langs).select(
        *key,
        F.when(F.col("tokens") > 0, F.expr("granted div tokens")).otherwise(F.lit(0)).alias("full"),
        F.when(F.col("tokens") > 0, F.expr("granted % tokens")).otherwise(F.lit(0)).alias("part"),
    )
    plan = written(plan, "plan")

    # the bucket of the partial epoch in which the part ends
    placed = narrow.join(plan, key).withColumn("at", order_key(seed, F.col("full"), F.col("id")))
    placed = placed.withColumn("bucket", F.substring("at", 1, BUCKET_DIGITS))
    buckets = placed.groupBy(*key, "bucket").agg(F.sum("tokens").alias("tokens"), F.first("part").alias("part"))
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    ends = buckets.where("part > 0 AND before <= part AND before + tokens > part").select(*key, "bucket", "before")
    # and the place in it; rows with one key stand together
    within = Window.partitionBy(*key, "bucket").orderBy("at")
    cuts = (
        placed.join(ends, [*key, "bucket"])
        .groupBy(*key, "bucket", "at")
        .agg(F.sum("tokens").alias("tokens"), F.first("part").alias("part"), F.first("before").alias("before"))
        .withColumn("upto", F.col("before") + F.sum("tokens").over(within))
        .where("upto > part")
        .groupBy(*key)
        .agg(F.min("at").alias("cut"))
    )
    # a row per leaf: Spark broadcasts this table where its files are small enough
    plan = written(
        plan.join(cuts, key, "left").select(
            F.col("domain").alias("l_domain"),
            F.col("lang").alias("l_lang"),
            F.col("source").alias("l_source"),
            F.col("full").alias("l_full"),
            F.col("cut").alias("l_cut"),
        ),
        "plan",
    )
    taken = F.when(
        order_key(seed, F.col("l_full"), F.col("l_doc")[id_col]) < F.col("l_cut"), F.col("l_full")
    ).otherwise(F.col("l_full") - 1)
    out = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("l_doc"), *[v.alias(k) for k, v in leaf.items()])
    out = out.join(plan, ["l_domain", "l_lang", "l_source"]).withColumn("l_last", taken.cast("long")).where("l_last >= 0")
    return out.select(
        *[F.col("l_doc")[c].alias(c) for c in docs.columns],
        F.col("l_domain").alias(n["domain"]),
        F.size(words(F.col("l_doc")[text_col])).cast("long").alias(n["tokens"]),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("l_last"))).alias(n["epoch"]),
    )
