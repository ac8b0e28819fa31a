"""Hosts, rules and the model, against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from buzzscore.llm import queries as Q
from buzzscore.llm import url_filter as U

URLS = [
    None,
    "",
    "no-scheme.example.org/es/",
    "http://EXAMPLE.org/es/1",
    "https://a.b.example.org/en/12?x=1",
    "https://example.org/en/2#top",
    "http://notexample.org/es/",
    "http://x.com/fr/825?page=2&ref=x",
    "http://x.com/de/",
    "http://com/de/1",
    "http://x.com/DE/1",
    "http://x.net",
    "http://x.org",
    "http://x.org?/",
    "ftp://ÄB.Org/q",
    "http://casino-best.example.net/en/1",
    "http://user@h.net:80/p//q://r",
    "http://h.net/" + "deep/" * 20_000,
    "http://x.net",
]


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [
        (len(r), r, v)
        for r, v in Q.URL_RULES
        for h, _, p in [r.partition("/")]
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p)
    ]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def model(spark):
    return U.fit(U.labelled_urls(spark))


def test_judgements(spark, model):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    out = U.judge(df, Q.URL_RULES, model)
    assert sorted(out.columns) == sorted(["page_id", "url", "host", "_host", "path", "rule", "verdict", "p_unwanted"])
    grams = df.select("page_id", U.grams(F.col("url")).alias("g")).collect()
    for x, g in zip(out.orderBy("page_id").collect(), grams, strict=True):
        assert (x["_host"], x["path"]) == host_path(x["url"])
        rule, verdict = rule_of(*host_path(x["url"]))
        assert x["rule"] == rule
        margin = model.bias + sum(model.weights[b] for b in g["g"]) / math.sqrt(max(1, len(g["g"])))
        assert x["p_unwanted"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=2e-6)
        assert x["verdict"] == (verdict or ("block" if x["p_unwanted"] >= 0.5 else "allow"))


def test_grams_against_a_loop(spark):
    df = spark.createDataFrame([("http://ab/c",), ("http://x.net/" + "y" * 50,)], "url string")
    for x in df.select("url", U.grams(F.col("url")).alias("g")).collect():
        strings = [(p, f"^{s}$"[i : i + n]) for p, s in zip(("host", "path"), host_path(x["url"]), strict=True) for n in U.GRAM_SIZES for i in range(len(s) + 3 - n)]
        rows = spark.createDataFrame(strings, "p string, g string")
        want = rows.select(F.pmod(F.xxhash64("p", "g"), F.lit(U.BUCKETS)).alias("b")).distinct().collect()
        assert x["g"] == sorted(r["b"] for r in want)


def test_held_out_words(spark, model):
    """Hosts whose words are not in the labelled table, but whose n-grams are."""
    bad = ["casino-royal", "free-bets-now", "cheap-viagra-pills", "porn-cams", "spam-links-farm", "poker-slots"]
    good = ["city-library", "garden-school", "music-history", "science-museum", "weather-news", "film-review"]
    df = spark.createDataFrame([(f"https://www.{h}.example.net/en/{i}", i) for i, h in enumerate(bad + good)], "url string, i int")
    got = [x["verdict"] for x in U.judge(df, (), model).orderBy("i").collect()]
    assert got[: len(bad)].count("block") >= 5  # of six
    assert got[len(bad) :] == ["allow"] * len(good)


def test_empty_tables_and_bounds(spark, model):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(empty, Q.URL_RULES, model).count() == 0
    with pytest.raises(ValueError):
        U.fit(spark.createDataFrame([("http://a/", 1)], "url string, label int"))


def test_no_python_in_the_plan(spark, model):
    plan = U.judge(spark.createDataFrame([], "url string"), Q.URL_RULES, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_url_of_a_megabyte(spark):
    """Every place of it counts: the only unusual n-grams are at its end."""
    long = "https://host.example.com/" + "abcdefghij" * 100_000
    df = spark.createDataFrame([(long,), (long + "zqx",), (long[:45],)], "url string")
    whole, other, short = [set(r.g) for r in df.select(U.grams(F.col("url")).alias("g")).collect()]
    assert short <= whole | other and len(whole ^ other) >= 3
