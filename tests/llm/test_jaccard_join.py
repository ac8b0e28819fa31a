"""The chosen-path join against all pairs."""

import random

import numpy as np
import pytest

from buzzscore.llm import jaccard_join as J


def brute(rows, similarity=0.8):
    """``[(id, rk, text)]`` -> class, group, copies, texts, links, first by rk."""
    sets = {}
    for _, rk, text in rows:
        w = (text or "").lower().split()
        sets[rk] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    place = {rk: (id_ is None, id_ or 0, rk) for id_, rk, _ in rows}
    ids = {rk: id_ for id_, rk, _ in rows}
    linked = {
        a: [b for b in sets if b != a and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])] if similarity == 0.8 else []
        for a in sets
    }
    out = {}
    for a in sets:
        group, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()]:
                if b not in group:
                    group.add(b)
                    todo.append(b)
        same = [b for b in linked[a] if sets[b] == sets[a]]
        head = min(group, key=place.get)
        out[a] = (
            ids[min([a, *same], key=place.get)],
            ids[head],
            len(same),
            len({sets[b] for b in linked[a]} - {sets[a]}),
            len(linked[a]),
            head == a,
        )
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    common = [word() for _ in range(30)]
    texts = [None, "", "  \n ", "a b c", "A  b c", "a b c d", "one", "x " * 3000]
    for _ in range(25):
        base = [word() for _ in range(r.choice([6, 20, 80, 200]))]
        if r.random() < 0.5:
            base = common + base
        for _ in range(r.choice([1, 2, 4])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("seed, bucket, block", [(1, 200, 128), (2, 3, 4)])
def test_against_all_pairs(make, monkeypatch, seed, bucket, block):
    """Small buckets and blocks send the same texts through deeper levels, pivots and tiles."""
    monkeypatch.setattr(J, "BUCKET", bucket)
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    texts = corpus(seed)
    ids = [None if i % 17 == 3 else i // 2 if i % 11 == 5 else i for i in range(len(texts))]
    df = make(texts, ids, parts=1)
    keyed = {x["rk"]: x for x in J.similar_texts(df, recall=0.9999).collect()}
    rows = [(x["doc_id"], i, x["text"]) for i, x in enumerate(df.collect())]
    got = {k: (x["class_id"], x["group_id"], x["n_copies"], x["n_texts"], x["n_links"], x["first"]) for k, x in keyed.items()}
    want = brute(rows)
    differ = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not differ


def test_empty_tables(make):
    assert J.similar_texts(make([])).count() == 0
    assert [x["first"] for x in J.similar_texts(make([None, ""])).collect()] == [True, True]


def test_runs_follow_the_recall():
    assert J.runs_for(0.99) == 13 and J.runs_for(0.9) < J.runs_for(0.999)
    r = np.random.default_rng(0)
    found = 0
    for _ in range(60):  # pairs at the threshold meet within the runs planned for the worst depth
        a = r.integers(0, 2**63, 900, dtype=np.uint64)
        b = np.concatenate([a[:800], r.integers(0, 2**63, 100, dtype=np.uint64)])
        e = np.stack([J.embed(np.unique(x) * np.uint64(2)) for x in (a, b)])
        roots = J._mix(np.arange(1, J.runs_for(0.99) + 1, dtype=np.uint64))
        met = False
        for root in roots:
            row, path = J._children(np.full(2, root), e, 0.8)
            met |= bool(set(path[row == 0]) & set(path[row == 1]))
        found += met
    assert found == 60
