"""Repeated byte strings, against a count of all windows."""

import collections
import random

import numpy as np
import pytest

from buzzscore.llm import suffix_dedup as S


def brute(texts, n=400):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        marks = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                marks[i] += 1
                marks[i + n] -= 1
        gone = np.cumsum(marks)[: len(t)] > 0
        runs = np.diff(gone.astype(int), prepend=0, append=0)
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((kept, len(t), int(gone.sum()), np.flatnonzero(runs == 1).tolist(), np.flatnonzero(runs == -1).tolist()))
    return out


def corpus(seed):
    r = random.Random(seed)
    rnd = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    long_ = [rnd(r.choice([390, 399, 400, 401, 450, 700, 1200])) for _ in range(8)]
    short = [rnd(r.choice([200, 300, 350])) for _ in range(3)]
    docs = ["", None, "ü" * 500, "a" * 1500, "ab" * 700, rnd(399)]
    for _ in range(50):
        d = ""
        for _ in range(r.randint(1, 5)):
            x, p = r.random(), r.choice(long_)
            k = r.randrange(len(p))
            d += rnd(r.randint(5, 600)) if x < 0.3 else p if x < 0.6 else p[:k] + "X" + p[k + 1 :] if x < 0.75 else r.choice(short) if x < 0.9 else p[k // 2 :]
        docs.append(d)
    return docs + docs[-3:]


@pytest.mark.parametrize("seed, family, chunk", [(1, 2000, 1 << 20), (2, 3, 1 << 20), (3, 2000, 1000)])
def test_against_all_windows(make, monkeypatch, seed, family, chunk):
    """Also with families too large for a task, and with texts longer than a piece."""
    monkeypatch.setattr(S, "FAMILY", family)
    monkeypatch.setattr(S, "CHUNK", chunk)
    docs = corpus(seed)
    df = make(docs)
    out = S.dedup_substrings(df)
    assert out.columns == [*df.columns, "_kept", "kept_text", "n_bytes", "n_removed", "n_spans", "starts", "stops"]
    got = {x["doc_id"]: (bytes(x["_kept"]), x["n_bytes"], x["n_removed"], x["starts"], x["stops"]) for x in out.collect()}
    want = brute([(t or "").encode() for t in docs])
    for x in out.collect():
        edges = [0, *[e for span in zip(x["starts"], x["stops"]) for e in span], x["n_bytes"]]
        whole = (docs[x["doc_id"]] or "").encode()
        assert x["kept_text"] == "".join(whole[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))
    assert {i: got[i] for i in range(len(docs))} == dict(enumerate(want))


def test_intervals_of_a_known_tree():
    # sorted suffixes of "banana": a ana anana banana na nana
    assert sorted(S.lcp_intervals(np.array([1, 3, 0, 0, 2]), 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


@pytest.mark.parametrize("seed", range(5))
def test_maximal_repeats_have_all_occurrences(monkeypatch, seed):
    """Each group agrees on exactly its extent, and holds all members that do."""
    monkeypatch.setattr(S, "KMER", 2)
    r = random.Random(seed)
    rnd = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    left, right = [rnd(r.randint(0, 6)) for _ in range(14)], [b"xy" + rnd(r.randint(0, 6)) for _ in range(14)]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    groups = list(S.maximal_repeats(left, right, 5))
    for l, rr, members in groups:  # noqa: E741
        fits = [i for i in range(14) if left[i][:l] == left[members[0]][:l] and right[i][:rr] == right[members[0]][:rr] and len(left[i]) >= l and len(right[i]) >= rr]
        assert l + rr >= 5 and sorted(members.tolist()) == fits
    best = {(a, b) for a in range(14) for b in range(a) if common(left[a], left[b]) + common(right[a], right[b]) >= 5}
    assert best == {(a, b) for _, _, m in groups for a in m.tolist() for b in m.tolist() if a > b}


def test_empty_table(make):
    assert S.dedup_substrings(make([])).count() == 0
