"""Block-max WAND and the whole operator, against plain scoring of every passage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from buzzscore.llm import decontaminate as D


@pytest.mark.parametrize("seed", range(4))
def test_wand_returns_all_from_the_threshold(monkeypatch, seed):
    monkeypatch.setattr(D, "BLOCK", 4)
    r = np.random.default_rng(seed)
    items, terms = 120, 60
    pairs = np.unique(np.stack([r.integers(0, items, 1500), (r.random(1500) ** 3 * terms).astype(int)], 1), axis=0)
    impact = r.random(len(pairs)) ** 2
    index = D.Index(pairs[:, 0], pairs[:, 1], impact, [(i, [], []) for i in range(items)], 1.2)
    for _ in range(30):
        query = np.unique(r.integers(0, len(index.terms), r.integers(1, 25)))
        score = np.zeros(items)
        for t in query:
            at = slice(index.start[t], index.end[t])
            score[index.item[at]] += index.impact[at]
        assert sorted(index.search(query)) == np.flatnonzero(score >= 1.2 - 1e-9).tolist()


def words(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, parts, impact, stride, threshold=0.5):
    """Every passage, every item: BM25 share, then trigrams of question and answer."""
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for text in docs:
        w, found = words(text), set()
        for b in range(0, len(w), stride):
            window = w[b : b + 2 * stride]
            have = set(window)
            for item, (q, a) in parts.items():
                if sum(v for t, v in impact.get(item, {}).items() if t in have) < threshold - 1e-9:
                    continue
                if all(not p or 2 * len(grams(p, min(3, len(p))) & grams(window, min(3, len(p)))) >= len(grams(p, min(3, len(p)))) for p in (q, a)):
                    found.add(item)
        out.append(sorted(found))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.choice([2, 3, 5]))) for _ in range(300)]
    word = lambda: vocab[int(r.random() ** 3 * 300)]
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [" ".join(sentence(r.randint(4, 12)) for _ in range(r.randint(1, 4))) for _ in range(25)] + [None, "", "One."]
    docs = [None, "", "x", "word " * 30_000]
    for _ in range(60):
        body = [sentence(r.randint(5, 30)) for _ in range(r.randint(1, 12))]
        x = r.random()
        if x < 0.4:
            t = r.choice(items[:25]).split()
            for _ in range(r.choice([0, 0, 1, 3, 8])):
                t[r.randrange(len(t))] = word()
            body.insert(r.randrange(len(body) + 1), " ".join(t))
        elif x < 0.5:  # the question without the answer
            body.append(r.choice(items[:25]).rsplit(". ", 1)[0])
        docs.append("\n".join(body))
    return docs + docs[-2:], items


@pytest.mark.parametrize("seed, postings", [(1, 1_000_000), (2, 60)])
def test_against_every_passage(spark, make, seed, postings):
    docs, items = corpus(seed)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    benchmark = D.build_index(table, max_postings=postings)
    assert (len(benchmark.shards) > 1) == (postings == 60)
    # the same parts and impacts, by word
    parts_df = D.item_parts(table, "item_id", "text")
    question, answer = D.question_and_answer(F.coalesce("text", F.lit("")))
    parts = {x["item_id"]: (words(x["q"]), words(x["a"])) for x in table.select("item_id", question.alias("q"), answer.alias("a")).collect()}
    assert benchmark.stride == max(len(q) + len(a) for q, a in parts.values())
    hashes = {t for q, a in parts.values() for t in q + a}
    known = {x["h"]: x["w"] for x in spark.createDataFrame([(t,) for t in hashes], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    number = {x["item"]: x["item_id"] for x in parts_df.collect()}
    impact = {}
    for x in D.postings(parts_df).collect():
        impact.setdefault(number[x["item"]], {})[known[x["term"]]] = x["impact"]
    assert all(abs(sum(v.values()) - 1) < 1e-9 for v in impact.values())
    df = make(docs)
    out = D.find_items(df, benchmark)
    got = {x["doc_id"]: x["_item_ids"] for x in out.collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, parts, impact, benchmark.stride)
    assert sum(map(len, got.values())) > 10


def test_question_and_answer(spark):
    rows = [("What is it? It is. A thing.",), ("One sentence only.",), ("First line\nsecond line",), ("",), ("A. B. C",)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(x) for x in df.select(*D.question_and_answer(F.col("t"))).collect()]
    assert got == [("What is it? It is.", "A thing"), ("One sentence only", ""), ("First line\n", "second line"), ("", ""), ("A. B.", "C")]


def test_empty_tables(spark, make):
    empty = spark.createDataFrame([], "item_id long, text string")
    out = D.find_items(make(["a b c", None]), D.build_index(empty))
    assert [x["_item_ids"] for x in out.collect()] == [[], []]
    full = D.build_index(spark.createDataFrame([(1, "a b c d.")], "item_id long, text string"))
    assert D.find_items(make([]), full).count() == 0


def test_an_index_beyond_the_bound_is_refused(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d."), (2, "e f g h.")], "item_id long, text string")
    monkeypatch.setattr(D, "MAX_INDEX", 7)
    with pytest.raises(ValueError, match="bound is 7"):
        D.build_index(items)
    monkeypatch.setattr(D, "MAX_INDEX", 8)
    assert D.build_index(items).shards
