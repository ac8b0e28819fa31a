"""Conversation repair, against a forward search over all edits in plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from buzzscore.llm import conversation_repair as C

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}
NON_SPACE = re.compile("[^\x20\x09-\x0d]")


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def brute(rows, ids):
    out = {}
    for conv in ids:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        counts, seen, fault = dict(blank=0, duplicate=0, truncated=0), set(), []
        for _, r, x in mine:
            solid = NON_SPACE.findall(x)
            f = "blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((r, x))
            fault.append(f)
            if f:
                counts[f] += 1
        ways = {0: (0, "", [])}

        def insert(ways):
            for _ in range(3):
                for q, (cost, e, lines) in list(ways.items()):
                    for (p, r), q2 in STEPS.items():
                        if p == q and r in FULL:
                            new = (cost + 2, e + "I", [*lines, FULL[r] + ":"])
                            ways[q2] = min(ways.get(q2, new), new)
            return ways

        for (_, role, text), f in zip(mine, fault):
            nxt = {}
            for q, (cost, e, lines) in insert(ways).items():
                options = [(q, (cost + 3, e + "D", lines))]
                if f not in ("blank", "duplicate"):
                    extra = f == "truncated"
                    if (q, role[:1]) in STEPS:
                        options.append((STEPS[q, role[:1]], (cost + extra, e + "K", [*lines, f"{role}:{text}"])))
                    options += [(STEPS[q, r], (cost + 2 + extra, e + "R", [*lines, f"{FULL[r]}:{text}"])) for r in FULL if (q, r) in STEPS]
                for q2, way in options:
                    nxt[q2] = min(nxt.get(q2, way), way)
            ways = nxt
        cost, edits, lines = min(w for q, w in insert(ways).items() if q in (0, 3)) if mine else (0, "", [])
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def collected(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def conversations(seed):
    r = random.Random(seed)
    text = lambda: r.choice(["Hi.", "What?", "no end", "", " \t\x0b", "same.", "Ünï! \n", None, f"t{r.random()}.", f"cut {r.random()}"])
    role = lambda: r.choice(["user"] * 6 + ["assistant"] * 6 + ["system", "System", "tool", "", None, "speaker"])
    rows = []
    for conv in [None, *range(40)]:
        for k in range(r.choice([1, 2, 3, 7, 20])):
            rows.append((conv, r.choice([k, k, k, k + 3, None]), role(), text()))
    rows += [(100, k, "user", f"only {k}.") for k in range(90)]  # one role: differences never settle
    rows += [(101, k, "user", "again.") for k in range(60)]  # all but one must go
    rows += [(102, 5, "assistant", "tie.")] * 30 + [(103, k, "a" if k % 2 else "u", f"{k}" * 2000) for k in range(70)]
    rows += [(104, 0, "system", "s."), (105, None, None, None), (106, -4, "user", "q?"), (106, -1, "assistant", "a.")]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, letters string, chunk int"


@pytest.mark.parametrize("seed, chunk, fixups", [(1, 4, 2), (2, 16, 0), (3, 128, 3)])
def test_against_all_edits(spark, monkeypatch, seed, chunk, fixups):
    """Chunks of a few rows, so that passes, matrices and stitching all run; columns with the operator's names."""
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "FIXUPS", fixups)
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    ids = {r[0] for r in rows}
    assert collected(C.repair(df)) == brute(rows, ids)
    if seed == 1:
        assert collected(C.damage_and_repair(df)) == brute(damaged(rows), ids)


def test_empty_table_and_all_dropped(spark):
    assert C.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.", "x", 1)], SCHEMA)
    assert collected(C.damage_and_repair(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("seed", range(20))
def test_a_rerun_stops_where_vectors_are_parallel(seed):
    """A fix-up pass gives what a whole run gives, and matrices give it too, but for a constant."""
    r = random.Random(seed)
    letters = "".join(r.choice("sua-SUA+x") for _ in range(r.randint(0, 30)))
    old, new = [0] * 4, [r.randint(0, 4) for _ in range(4)]
    assert C.fix_up(letters, old, C.run_back(letters, old), new) == C.level(C.run_back(letters, new))
    m, v = C.matrix(letters), C.closed(new)
    assert C.level([min(m[4 * q + p] + v[p] for p in range(4)) for q in range(4)]) == C.level(C.run_back(letters, new))
