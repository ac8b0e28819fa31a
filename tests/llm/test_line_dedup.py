"""Line dedup against a plain loop."""

import random

import pytest

from buzzscore.llm.line_dedup import dedup_lines

LINES = ["alpha beta", "gamma", "", "delta epsilon zeta", "eta", "theta iota", "  ", "kappa"]


def brute(rows):
    """``[(id, place, text)]`` -> kept text, lines, removed, runs by place."""
    seen, out = set(), {}
    for id_, place, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if text is None:
            out[place] = (None, 0, 0, 0)
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if not "".join(window).strip(" "):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        runs = sum(i - 1 not in gone for i in gone)
        out[place] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), runs)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make, seed):
    r = random.Random(seed)
    texts = ["\n".join(r.choice(LINES) for _ in range(r.randint(1, 14))) for _ in range(60)]
    texts += [None, "", "\n\n\n\n", "one", "a\nb", "x\ny\nz", "x\ny\nz", "w\nx\ny\nz\nx\ny\nz"]
    texts += ["\n".join(f"line {i % 5000}" for i in range(20000))]  # a very long text that repeats itself
    df = make(texts, parts=1)
    got = {x["rk"]: (x["text"], x["_n_lines"], x["n_removed"], x["n_spans"]) for x in dedup_lines(df).collect()}
    assert got == brute([(i, i, t) for i, t in enumerate(texts)])


def test_ids_that_repeat_or_are_null(make):
    texts = ["a\nb\nc"] * 4
    df = make(texts, ids=[None, 7, 7, None], parts=1)
    kept = [(x["doc_id"], x["text"]) for x in dedup_lines(df).collect()]
    assert sorted(kept, key=str) == [(7, ""), (7, "a\nb\nc"), (None, ""), (None, "")]


def test_empty_table_and_columns(make):
    out = dedup_lines(make([]))
    assert out.count() == 0
    assert out.columns[-3:] == ["_n_lines", "n_removed", "n_spans"]


def test_no_python_in_the_plan(make):
    plan = dedup_lines(make(["a\nb\nc"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
