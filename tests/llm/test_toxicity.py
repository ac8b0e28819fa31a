"""The learner, its features, and scores of whole tables."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from buzzscore.llm import queries as Q
from buzzscore.llm import toxicity as T


def plain_margin(words, dense):
    """Sum of the weights of the distinct coordinates of one text."""
    return float(sum(dense[c] for c in set(np.concatenate(T.coordinates(np.array(words, np.int64))).tolist())))


def test_margins_do_not_cross_texts():
    r = np.random.default_rng(1)
    dense = np.where(r.random(1 << T.BITS) < 0.3, r.normal(size=1 << T.BITS), 0).astype(np.float32)
    texts = [r.integers(-(2**62), 2**62, n).tolist() for n in (0, 1, 2, 3, 50, 0, 700)]
    texts.append(texts[4] + texts[4])
    got = T.margins(pa.array(texts, pa.list_(pa.int64())), dense)
    assert np.allclose(got, [plain_margin(t, dense) for t in texts], atol=1e-3)


def test_ftrl_against_the_formula():
    """Lazy weights equal those of the published update, coordinate by coordinate."""
    m, r = T.Ftrl(alpha=0.3, l1=0.5, l2=0.2, positive=2.0), random.Random(3)
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 1 << T.BITS else 0.5
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.2)

    for _ in range(200):
        f = sorted(r.sample(range(20), 4))
        y = int(3 in f)
        m.learn(np.array(f), y)
        at = [*f, 1 << T.BITS]
        w = {i: weight(i) for i in at}
        g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (2.0 if y else 1.0)
        for i in at:
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.3
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(m.weights(np.arange(20)), [weight(i) for i in range(20)])
    assert m.weights(np.array([3]))[0] > 0


def labelled(seed=5, n=600):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        t = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["badword", "Uglyword!", "mean thing"]))
        texts.append(" ".join(t))
        labels.append(int(bad))
    return texts, labels


def test_held_out_accuracy_and_edges(spark, make):
    texts, labels = labelled()
    extra = [None, "", "...", "plain " * 100_000, texts[0], texts[0]]
    docs = make(texts + extra)
    known = spark.createDataFrame([(i, y, "x") for i, y in enumerate(labels) if i % 3] + [(None, 1, "x"), (1, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, score string")
    model = T.fit(docs, known)
    assert 0 < len(model.at) < 3000
    out = T.score(docs, model)
    assert out.columns == [*docs.columns, "_score", "_predicted"]
    got = {x["doc_id"]: (x["_score"], x["_predicted"]) for x in out.collect()}
    held = [i for i in range(len(texts)) if i % 3 == 0]
    wrong = sum(got[i][1] != labels[i] for i in held)
    assert wrong <= 0.02 * len(held)
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in got.values())
    n = len(texts)
    bias = 1 / (1 + np.exp(-model.bias))
    assert [abs(got[n + k][0] - bias) < 1e-6 for k in range(3)] == [True] * 3
    assert got[n + 4] == got[n + 5] == got[0]


def test_bounded_rows_and_no_rows(spark, make):
    texts, labels = labelled(n=60)
    docs = make(texts)
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    T.fit(docs, known, max_rows=10)
    none = T.fit(docs, known.limit(0))
    assert none.bias == 0 and not len(none.at)
    assert {x["_score"] for x in T.score(docs, none).collect()} == {0.5}
    assert T.score(make([]), none).count() == 0


def test_fold_is_the_checksum(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in [*range(50), -3, None]], "doc_id long")
    for x in df.select("doc_id", Q.held_out(F.col("doc_id")).alias("h")).collect():
        text = "" if x["doc_id"] is None else str(x["doc_id"])
        assert x["h"] == (zlib.crc32(text.encode()) % 5 == 0)
