"""URL verdicts: host and path rules first, a linear model for the rest.

The model is a logistic regression on hashed character n-grams of host and
path, fitted to a small labelled table by gradient steps whose sums are
DataFrame aggregates.  Only the weights (``BUCKETS`` numbers) pass through the
driver.  They return as a constant array, so that scoring is one projection
over the pages: no join, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzscore.llm.common import fresh, let

BUCKETS = 1 << 12
GRAM_SIZES = (3, 4, 5)
#: The labelled table may have so many rows; a larger one is refused, not cut.
MAX_LABELLED = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The small labelled table of the registered query: words that hosts of unwanted
# pages are made of, and of ordinary ones; and ordinary path pieces.
UNWANTED = (
    "casino poker jackpot slots bets betting gamble roulette lottery win-big adult xxx porn sex escort "
    "cams dating-hot pills viagra pharma-cheap cheap-meds replica-watches payday-loans fast-cash "
    "spam spam-links link-farm ads adserver adnet tracker popunder clicktrack malware warez crack keygen"
).split()
ORDINARY = (
    "news library museum school university garden kitchen travel recipes weather history science health "
    "city council radio journal press books music film sports football chess forum wiki docs support "
    "research maps archive photo art design theatre nature cycling parents review gazette"
).split()
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}", "/about/{}", "/2021/{}.html", "/index.html")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path from there to ``? #``.

    A null url, or one without ``://``, has an empty host and an empty path.
    """
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``(url, label)``: 1 for unwanted hosts, 0 for ordinary ones."""
    rows = []
    for label, names in ((1, UNWANTED), (0, ORDINARY)):
        for k, name in enumerate(names):
            for j, prefix in enumerate(("", "www.", "blog.", "m.")):
                path = PATHS[(k + 3 * j) % len(PATHS)].format(37 * k + 11 * j)
                other = names[(k + 7) % len(names)]
                tld = ("com", "net", "org")[(k + j) % 3]
                rows.append((f"https://{prefix}{name if j % 2 else f'{name}-{other}'}.example.{tld}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def grams(url: Column) -> Column:
    """Sorted, distinct buckets of the n-grams of the host and of the path.

    Both parts have a mark at either end, so that a part too short for an
    n-gram of one size still has one of another; an empty url has none.
    """

    def of(chars: Column, name: str, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.pmod(
                F.xxhash64(F.lit(name), F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(BUCKETS)
            ).cast("int"),
        )

    def all_sizes(part: Column, name: str) -> Column:
        # cut into characters once: looking one up by its place does not read the text again
        marked = F.when(part != "", F.split(F.concat(F.lit("^"), part, F.lit("$")), "")).otherwise(F.array().cast("array<string>"))
        return let(marked, lambda chars: F.concat(*[of(chars, name, n) for n in GRAM_SIZES]))

    host, path = host_and_path(url)
    return F.array_sort(F.array_distinct(F.concat(all_sizes(host, "host"), all_sizes(path, "path"))))


def _constant(values: Iterable[float]) -> Column:
    """The numbers as an array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]

    def probability(self, buckets: Column) -> Column:
        """Of label 1. Each bucket counts ``1 / sqrt(buckets)``, long and short urls alike."""
        weights = _constant(self.weights)
        total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
        size = F.greatest(F.size(buckets), F.lit(1)).cast("double")
        return 1 / (1 + F.exp(-(F.lit(self.bias) + total / F.sqrt(size))))


def fit(
    labelled: DataFrame, steps: int = 25, rate: float = 60.0, ridge: float = 1e-3, ordinary: float = 3.0
) -> UrlModel:
    """Fit to ``labelled (url, label)``; rows with a null label are left out.

    Gradient descent with momentum on the mean logistic loss; the class of
    ordinary urls weighs ``ordinary`` times that of unwanted ones, since a page
    blocked in error is lost.  A step is one aggregation of the table: at most
    ``BUCKETS`` sums come back.
    """
    data = labelled.where("label IN (0, 1)").select(grams(F.col("url")).alias("b"), F.col("label").cast("double"))
    data = data.persist()
    try:
        n, positive = data.agg(F.count(F.lit(1)), F.sum("label")).first()
        if n > MAX_LABELLED:
            raise ValueError(f"{n} labelled urls; the bound is {MAX_LABELLED}")
        if not n or not 0 < positive < n:
            raise ValueError("the labelled urls must have both labels")
        whole = 1 + ordinary
        share = F.when(F.col("label") == 1, 1 / whole / positive).otherwise(ordinary / whole / (n - positive))
        weights, bias, speed, bias_speed = [0.0] * BUCKETS, 0.0, [0.0] * BUCKETS, 0.0
        for _ in range(steps):
            model = UrlModel(bias, tuple(weights))
            error = share * (model.probability(F.col("b")) - F.col("label"))
            size = F.greatest(F.size("b"), F.lit(1)).cast("double")
            rows = data.select(error.alias("e"), (error / F.sqrt(size)).alias("g"), "b")
            # the bias is bucket -1 of every row
            each = rows.select(
                "e", "g", F.explode(F.concat(F.array(F.lit(-1)), "b")).alias("bucket")
            ).select("bucket", F.when(F.col("bucket") < 0, F.col("e")).otherwise(F.col("g")).alias("g"))
            for bucket, gradient in each.groupBy("bucket").agg(F.sum("g")).collect():
                if bucket < 0:
                    bias_speed = 0.8 * bias_speed - rate * gradient / 4
                else:
                    speed[bucket] = 0.8 * speed[bucket] - rate * gradient
            bias += bias_speed
            weights = [w * (1 - ridge) + v for w, v in zip(weights, speed, strict=True)]
        return UrlModel(bias, tuple(weights))
    finally:
        data.unpersist()


def _best_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict), or null."""
    found = []
    for rule, verdict in rules:
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        found.append(
            F.when(
                fits,
                F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")),
            )
        )
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def judge(
    pages: DataFrame, rules: Iterable[tuple[str, str]], model: UrlModel, url_col: str = "url", threshold: float = 0.5
) -> DataFrame:
    """All rows and columns of ``pages``, and ``host, path, rule, verdict, p_unwanted``.

    ``rules`` are (``host/path``, ``allow`` or ``block``): a rule fits its host
    and all subdomains where the url's path starts with the rule's; the longest
    wins.  Without a fitting rule the model decides: ``block`` from
    ``threshold`` on.

    * A null url, or one without ``://``, has an empty host and path, fits no
      rule and is judged by the model's bias.
    * Urls of any length are scored whole; repeated rows are judged alike.
    * Columns of ``pages`` that have a result's name are kept; the result then
      carries underscores in front.
    """
    host, path = host_and_path(F.col(url_col))
    names = {k: fresh(pages, k) for k in ("host", "path", "rule", "verdict", "p_unwanted", "best")}
    out = pages.withColumns({names["host"]: host, names["path"]: path})
    out = out.withColumns(
        {
            names["best"]: _best_rule(F.col(names["host"]), F.col(names["path"]), tuple(rules)),
            names["p_unwanted"]: F.round(model.probability(grams(F.col(url_col))), 6),
        }
    )
    best = F.col(names["best"])
    return out.withColumns(
        {
            names["rule"]: best["rule"],
            names["verdict"]: F.coalesce(
                best["verdict"], F.when(F.col(names["p_unwanted"]) >= threshold, "block").otherwise("allow")
            ),
        }
    ).drop(names["best"])
