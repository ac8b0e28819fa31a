"""The filter audit, against a count over all orders in plain Python."""

import itertools
import re
from collections import Counter

import pytest

from buzzscore.llm import filter_audit as A
from buzzscore.llm.common import scratch


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    counts = Counter()
    for i, text, lang in rows:
        t = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200,
            100 * len(set(w)) < 50 * len(w),
            100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            re.search("[#$%&*|]", t),
            i is not None and i > least[t],
        )) if bad}
        counts[lang or "", frozenset(fails), i in good, i in toxic] += 1
    out = {}
    for part in {k[0] for k in counts}:
        removed_in_all = Counter()
        for order in itertools.permutations("ABCDE"):
            left = {k: n for k, n in counts.items() if k[0] == part}
            for step, f in enumerate(order, 1):
                here = {k: n for k, n in left.items() if f in k[1]}
                all_fail = sum(n for k, n in counts.items() if k[0] == part and f in k[1])
                left = {k: n for k, n in left.items() if f not in k[1]}
                removed_in_all[f] += sum(here.values())
                out[part, "".join(order), step] = [
                    sum(left.values()), sum(here.values()), all_fail - sum(here.values()),
                    sum(n for k, n in counts.items() if k[0] == part and k[1] == {f}),
                    sum(n for k, n in here.items() if k[2]), sum(n for k, n in here.items() if k[3]),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_in_all[order[step - 1]])
    return out


def table(spark, rows, path, mode="append"):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, mask string")
    df.coalesce(1).write.mode(mode).parquet(path)


def got(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    # (id, text, lang): later files bring smaller ids, so first holders are retracted, twice for LONG
    [(90, LONG, "en"), (91, LONG, "de"), (50, "short ONE", None), (60, "", ""), (None, LONG, "en"), (70, "a a a a |", "fr")],
    [(40, LONG, "en"), (40, LONG, "de"), (95, "short ONE", "en"), (61, None, "en"), (None, None, "en")],
    [(7, LONG, "fr"), (8, LONG + " B" * 400, "fr"), (49, "short ONE", "en")] + [(1000 + i, LONG, "en") for i in range(30)],
    [(7, LONG, "fr"), (3, "ünï #\v tag", "es"), (2, LONG + "\x0bX" * 5000, "es")],
]
LABELS = [(7, 1, 0), (90, 1, 1), (90, 0, 0), (40, 0, 1), (50, 1, None), (None, 1, 1), (49, None, 1), (1003, 1, 0), (999, 1, 1)]


def test_smaller_ids_that_arrive_later(spark):
    """One file a micro-batch; then the same again in two calls on one folder, the second after more files."""
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    path, home = scratch(spark, "docs") + ".parquet", scratch(spark, "home")
    for rows in ROWS[:2]:
        table(spark, rows, path)
    assert got(A.audit(spark, path, labels, home, files_per_batch=1)) == brute(sum(ROWS[:2], []), LABELS)
    for rows in ROWS[2:]:
        table(spark, rows, path)
    assert got(A.audit(spark, path, labels, home)) == brute(sum(ROWS, []), LABELS)


def test_single_file_and_empty_table(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    path = scratch(spark, "docs") + ".parquet"
    table(spark, [], path)
    assert A.audit(spark, path, labels).count() == 0
    path = scratch(spark, "docs") + ".parquet"
    table(spark, ROWS[0], path)
    assert got(A.audit(spark, path, labels.limit(0))) == brute(ROWS[0], [])


@pytest.mark.parametrize("order", list(itertools.permutations(range(4))))
def test_changes_sum_to_the_same_in_any_order(order):
    import pandas as pd
    import pyarrow as pa

    ids = [30, 10, 20, 10]
    held, total = pa.schema(A._FIELDS).empty_table(), Counter()
    for k in order:
        frame = pd.DataFrame([(b"k" * 16, ids[k], "p" if k < 3 else "q", 1, ids[k] == 10, False, 1)], columns=[f for f, _ in A._FIELDS])
        held, counted = A.merge(held, frame)
        for r in counted.itertuples():
            total[r.part, r.mask, r.good] += r.n
    assert {k: n for k, n in total.items() if n} == {("p", 1, True): 1, ("q", 1, True): 1, ("p", 17, False): 2}
    assert held.num_rows == 2
