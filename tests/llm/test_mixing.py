"""Budgets against plain water filling, and the mixture against a sorted list."""

import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from buzzscore.llm import mixing as M


def fill(budget, children):
    """``{name: (weight, capacity)}`` -> shares: raise the level until the budget is spent."""
    open_, got, rest = dict(children), {}, budget
    while open_:
        level = Fraction(rest, sum(w for w, _ in open_.values()))
        full = {k: c for k, (w, c) in open_.items() if c <= w * level}
        if not full:
            return got | {k: int(w * level) for k, (w, _) in open_.items()}
        for k, c in full.items():
            got[k], rest = c, rest - c
            del open_[k]
    return got


DOMAINS, LANGS = {"web": 5, "books": 3, "code": 2}, {"en": 60, "de": 15, "fr": 15, "es": 10}


def brute_budgets(leaves, total, epochs):
    cap = lambda *key: sum(t * epochs for k, t in leaves.items() if k[: len(key)] == key)
    out = {}
    top = fill(total, {d: (DOMAINS.get(d, 1), cap(d)) for d, _, _ in leaves})
    for d, b in top.items():
        mid = fill(b, {x: (LANGS.get(x, 1), cap(d, x)) for e, x, _ in leaves if e == d})
        for x, c in mid.items():
            low = fill(c, {s: (1, cap(d, x, s)) for e, y, s in leaves if (e, y) == (d, x)})
            out |= {(d, x, s): v for s, v in low.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets(spark, seed):
    r = random.Random(seed)
    leaves = {
        (d, x, f"s{i}"): r.choice([0, 1, 7, 50, 400, 10**12])
        for d in ("web", "books", "code", "other")
        for x in ("en", "de", "(none)")
        for i in range(r.randint(1, 5))
    }
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    for total in (0, 17, 3000, 10**13):
        got = {(x["domain"], x["lang"], x["source"]): x["granted"] for x in M.leaf_budgets(df, total, 2, DOMAINS, LANGS).collect()}
        assert got == brute_budgets(leaves, total, 2)


def brute_mix(rows, share, epochs, seed):
    """``[(place, id, text, lang, source, domain)]`` -> (place, epoch) taken."""
    tokens = {p: len((t or "").split()) for p, _, t, *_ in rows}
    leaf = {p: (d or "(none)", lang or "(none)", s or "(none)") for p, _, _, lang, s, d in rows}
    sums = {}
    for p in tokens:
        sums[leaf[p]] = sums.get(leaf[p], 0) + tokens[p]
    granted = brute_budgets(sums, int(sum(tokens.values()) * share), epochs)
    out = []
    for key, total in sums.items():
        if not total:
            continue
        full, part = divmod(granted[key], total)
        mine = [(hashlib.md5(f"{seed}:{full}:{'' if i is None else i}".encode()).hexdigest(), p) for p, i, *_ in rows if leaf[p] == key]
        out += [(p, e) for _, p in mine for e in range(full)]
        spent, cut = 0, None
        for at in sorted({a for a, _ in mine}):
            spent += sum(tokens[p] for a, p in mine if a == at)
            if part and spent > part:
                cut = at
                break
        out += [(p, full) for a, p in mine if cut and a < cut]
    return sorted(out)


@pytest.mark.parametrize("share, epochs", [(0.5, 2), (1.3, 2), (5.0, 3), (0.0, 1)])
def test_mixture(make, share, epochs):
    r = random.Random(9)
    texts = [None, "", "  \n"] + [" ".join("w" * r.randint(1, 3) for _ in range(r.choice([1, 5, 60]))) for _ in range(150)] + ["long " * 50_000]
    ids = [None if i % 29 == 5 else i // 2 if i % 13 == 1 else i for i in range(len(texts))]
    df = make(texts, ids)
    df = df.withColumn("source", F.expr("CASE WHEN rk % 3 = 0 THEN 'hot' ELSE source END"))
    domain = F.when(F.col("rk") % 4 == 0, F.lit(None)).when(F.col("rk") % 2 == 0, "web").otherwise("books")
    out = M.mix(df, domain, DOMAINS, LANGS, share=share, epochs=epochs)
    assert out.columns == [*df.columns, "domain", "_tokens", "_epoch"]
    rows = [(x["rk"], x["doc_id"], x["text"], x["lang"], x["source"], x["d"]) for x in df.withColumn("d", domain).collect()]
    got = sorted((x["rk"], x["_epoch"]) for x in out.collect())
    assert got == brute_mix(rows, share, epochs, 7)


def test_empty_table(make):
    assert M.mix(make([]), F.lit("web"), DOMAINS, LANGS).count() == 0
