"""Cheapest repair of damaged conversations, by a parallel Viterbi search.

The edits of a conversation are a path through a small automaton: its states
are where the role pattern ``(s?(ua)+)?`` stands, its steps keep, rerole or
delete the next row or insert a row.  Viterbi's costs run backward: the vector
of a place has, for each state, the cost of the cheapest way from there to an
allowed end.

All rows are sorted by conversation and turn over all tasks and cut into
chunks of ``CHUNK`` rows, so a conversation of any length is many chunks.

* Every chunk starts from a *speculative* vector at its end (zeros; the last
  chunk of a conversation has the true one) and runs backward.
* *Fix-up passes*: a chunk whose successor's first vector is not the one it
  started from is run again from that one, next to its former run, until both
  differ by a constant only; from there on it is as before, and so is all
  before it.  Costs are only compared within a place, so constants do not
  matter.  Passes go on until no chunk has to be run again.
* Chunks that keep their differences (a long run of one role does) would hand
  on a change one chunk a pass.  What is left after ``FIXUPS`` passes is
  settled in a number of rounds that grows with the logarithm of the chunks: a
  chunk as a min-plus matrix, and matrices of neighbouring chunks multiplied.
* *Tracing*: with its end vector known, a chunk follows the least letters of
  the cheapest edits from each of the states it may be entered in; the states
  are stitched together over the chunks, again in logarithmic rounds, and each
  chunk writes the edits from the state that it is entered in.

Deleting costs no decision where it must be (blank and repeated rows): the
state stays, so such rows pass a vector on unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buzzscore.llm.common import written

# --- fixed values: the damage and the costs ------------------------------------
DROP, EMPTY, STRIP, REPEAT, REROLE = range(5)
KINDS = 20
SPACE = " \t-\r"
STOPS = "[.!?]"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
# -------------------------------------------------------------------------------
#: Rows of a chunk.
CHUNK = 128
#: Fix-up passes before the chunks that still change are settled by matrices.
FIXUPS = 3

# States: nothing yet, after s, after u, after a.  A role leads from a state to
# another; rows are inserted and reroled as user or assistant only.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {q: next(r for r in "ua" if (q, r) in NEXT) for q in range(4)}
NAME = {"u": "user", "a": "assistant"}
ONWARD = [NEXT[q, ROLE[q]] for q in range(4)]  # by inserting or reroling
ENDS = (0, 3)
FAR = 1 << 40  # more than any cost
KEEP_TO = {r: [NEXT.get((q, r), -1) for q in range(4)] for r in "sua-"}


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with every row damaged by the checksum of ``conv_id:turn``.

    Of 20 kinds, 0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3
    repeats it, 4 makes it the user's; a null in any column counts as a space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % KINDS
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == EMPTY, "").when(kind == STRIP, F.regexp_replace("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(kind == REROLE, "user").otherwise(F.col("role"))
    rows = rows.where(kind != DROP).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == REPEAT, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


# --- the costs of one chunk ----------------------------------------------------
# A row is a letter: role s, u, a or - (any other), in capitals (and + for -) if
# the row is truncated; x if it has to be deleted.
def closed(v: list[int]) -> list[int]:
    """``v`` with insertions allowed first; two after each other reach all there is."""
    for _ in range(2):
        v = [min(v[q], INSERT_COST + v[ONWARD[q]]) for q in range(4)]
    return v


END = closed([0 if q in ENDS else FAR for q in range(4)])


def before(letter: str, v: list[int]) -> list[int]:
    """The vector before a row, from the closed one after it."""
    if letter == "x":
        return [c + DELETE_COST for c in v]
    extra = TRUNCATED_COST if letter == "+" or letter.isupper() else 0
    keep = KEEP_TO["-" if letter == "+" else letter.lower()]
    best = []
    for q in range(4):
        c = min(DELETE_COST + v[q], REROLE_COST + extra + v[ONWARD[q]])
        best.append(min(c, extra + v[keep[q]]) if keep[q] >= 0 else c)
    return closed(best)


def level(v: list[int]) -> list[int]:
    """Without the constant: vectors that differ by a constant are equal."""
    least = min(v)
    return [c - least for c in v]


def run_back(letters: str, end: list[int]) -> list[int]:
    v = closed(end)
    for letter in reversed(letters):
        v = level(before(letter, v))
    return v


def fix_up(letters: str, former: list[int], first: list[int], end: list[int]) -> list[int]:
    """The first vector from ``end``; ``first`` is the one from ``former``."""
    old, new = level(closed(former)), level(closed(end))
    for letter in reversed(letters):
        if old == new:
            return first
        old, new = level(before(letter, old)), level(before(letter, new))
    return new


def matrix(letters: str) -> list[int]:
    """Costs from each state before the chunk to each one after it, by rows."""
    columns = []
    for p in range(4):
        v = closed([0 if q == p else FAR for q in range(4)])
        for letter in reversed(letters):
            v = before(letter, v)
        columns.append([min(c, FAR) for c in v])
    return [columns[p][q] for q in range(4) for p in range(4)]


def trace(letters: str, end: list[int], state: int, last: bool) -> dict:
    """The cheapest edits from ``state``, the least letters first: the ``state`` after, ``cost`` and ``edits``.

    A row's edit follows the insertions before it; the last chunk's end in the
    insertions that end the conversation.
    """
    vectors = [closed(end)]
    for letter in reversed(letters):
        vectors.append(before(letter, vectors[-1]))
    cost, edits = 0, []
    for letter, here, after in zip(letters, vectors[::-1], vectors[-2::-1], strict=False):
        while True:
            left = here[state]
            if DELETE_COST + after[state] == left:
                edits.append("D")
                cost += DELETE_COST
                break
            if INSERT_COST + here[ONWARD[state]] == left:
                edits.append("I")
                cost += INSERT_COST
                state = ONWARD[state]
                continue
            extra = TRUNCATED_COST if letter == "+" or letter.isupper() else 0
            keep = KEEP_TO["-" if letter == "+" else letter.lower()][state]
            if keep >= 0 and extra + after[keep] == left:
                edits.append("K")
                cost, state = cost + extra, keep
            else:
                edits.append("R")
                cost, state = cost + REROLE_COST + extra, ONWARD[state]
            break
    while last and state not in ENDS:
        edits.append("I")
        cost, state = cost + INSERT_COST, ONWARD[state]
    return {"state": state, "cost": cost, "edits": "".join(edits)}


# --- over the chunks, in Spark -------------------------------------------------
KEY = ["conv", "no_conv"]
_PLACE = [*KEY, "chunk"]


def in_order(rows: DataFrame) -> DataFrame:
    """``conv, no_conv, chunk, spot`` and the rows: all rows sorted over all tasks and numbered without gaps.

    Rows go by conversation, turn (nulls first), role and the digest of the
    text.  A long conversation is spread over as many ranges as it takes.  The
    numbers come from the places in the written ranges and the ranges' sizes, a
    row per range.
    """
    conv, text = F.col("conv_id"), F.coalesce("text", F.lit(" "))
    keyed = rows.select(
        F.coalesce(conv, F.lit(0).cast("long")).alias("conv"),
        conv.isNull().alias("no_conv"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    order = ["no_conv", "conv", "turn", "role", "digest"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("rk", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("rk", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before_ = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = F.broadcast(sizes.select("part", before_.alias("start")))  # a row per range, shuffle partitions at most
    number = F.col("rk") - F.shiftleft(part, 33) + F.col("start")
    spots = ranged.join(starts, part == F.col("part")).withColumn("spot", number)
    return spots.drop("rk", "part", "start").withColumn("chunk", F.floor(F.col("spot") / CHUNK).cast("long"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows of :func:`in_order` with ``fault``: ``blank``, ``duplicate``, ``truncated`` or null, the first that holds."""
    same = [*KEY, "role", "digest"]
    firsts = rows.groupBy(*same).agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "firsts")  # so that the join has shuffles only and Spark can split a hot key
    rows = rows.join(firsts, same, "left")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"{STOPS}[{SPACE}]*\z")
    fault = F.when(blank, "blank").when(F.col("spot") > F.col("first"), "duplicate").when(cut, "truncated")
    return rows.withColumn("fault", fault).drop("first", "digest")


def _letter() -> Column:
    initial = F.substring("role", 1, 1)
    truncated = F.coalesce(F.col("fault") == "truncated", F.lit(False))
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    loud = F.when(plain == "-", "+").otherwise(F.upper(plain))
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(truncated, loud).otherwise(plain)


def chunked(rows: DataFrame) -> DataFrame:
    """One row per conversation and chunk: its letters, roles and texts in order, and what is counted of it."""
    fields = F.struct("spot", "turn", "role", "text", _letter().alias("letter"), "fault").alias("row")
    pieces = rows.select(*_PLACE, fields).groupBy(*_PLACE).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    initial = lambda r: F.substring(r["role"], 1, 1)
    pair = lambda a, b: F.when(F.concat(initial(a), initial(b)).isin("su", "ua", "au"), 0).otherwise(1)
    neighbours = F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows")), pair)
    count = lambda what: F.size(F.filter("rows", lambda r: r["fault"] == what)).cast("long")
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    first, last = F.element_at("rows", 1), F.element_at("rows", -1)
    return pieces.select(
        *_PLACE,
        F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("letters"),
        F.transform("rows", lambda r: r["role"]).alias("roles"),
        F.transform("rows", lambda r: r["text"]).alias("texts"),
        count("blank").alias("blank"),
        count("duplicate").alias("duplicate"),
        count("truncated").alias("truncated"),
        F.when(F.size("rows") > 1, F.aggregate(neighbours, F.lit(0), lambda a, b: a + b)).otherwise(0).cast("long").alias("illegal"),
        initial(first).alias("opens"),
        initial(last).alias("closes"),
        F.array_min(turns).alias("low"),
        F.array_max(turns).alias("high"),
        F.size(F.array_distinct(turns)).cast("long").alias("turns"),
    )


def _per_chunk(df: DataFrame, name: str, kind: str, inputs: list[str], of) -> DataFrame:
    """``df`` with the column ``name``: ``of`` the values of ``inputs``, computed in Arrow batches."""

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([of(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], arrow)

    arrow = {
        "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
        "struct<state:int,cost:long,edits:string>": pa.struct([("state", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]),
    }[kind]
    return df.withColumn(name, F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(*inputs))


def _shifted(df: DataFrame, by: int, **columns: str) -> DataFrame:
    """What the chunk ``by`` places on has, under the place of this one."""
    return df.select(*KEY, (F.col("chunk") - by).alias("chunk"), *[F.col(c).alias(n) for n, c in columns.items()])


def end_vectors(pieces: DataFrame, fixups: int | None = None) -> DataFrame:
    """``conv, no_conv, chunk, letters, last, end``: each chunk's vector of costs at its end, but for a constant."""
    fixups = FIXUPS if fixups is None else fixups
    onward = _shifted(pieces, 1).withColumn("more", F.lit(True))
    table = pieces.select(*_PLACE, "letters").join(onward, _PLACE, "left")
    table = table.withColumn("last", F.col("more").isNull()).drop("more")
    vector = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    table = table.withColumn("end", F.when(F.col("last"), vector(level(END))).otherwise(vector([0] * 4)))
    table = written(_per_chunk(table, "first", "array<long>", ["letters", "end"], run_back), "speculated")

    def rerun(letters, former, first, end):
        return first if end is None or end == former else fix_up(letters, former, first, end)

    for _ in range(fixups):
        met = table.join(_shifted(table, 1, truth="first"), _PLACE, "left")
        if met.where(F.col("truth") != F.col("end")).isEmpty():
            return table.drop("first")
        met = _per_chunk(met, "fixed", "array<long>", ["letters", "end", "first", "truth"], rerun)
        columns = [*_PLACE, "letters", "last", F.coalesce("truth", "end").alias("end"), F.col("fixed").alias("first")]
        table = written(met.select(*columns), "fixed")
    return _by_matrices(table)


def _product(a: Column, b: Column) -> Column:
    """The min-plus product of two matrices or, of a matrix and a vector, all as flat arrays of four columns."""
    cell = lambda x, q, p: F.array_min(F.array(*[F.get(x, F.lit(4 * q + k)) + F.get(b, p + 4 * k) for k in range(4)]))
    return F.array(*[F.least(cell(a, q, F.lit(p)), F.lit(FAR)) for q in range(4) for p in range(4)])


def _by_matrices(table: DataFrame) -> DataFrame:
    """:func:`end_vectors` of the conversations whose chunks do not agree yet, by products over 1, 2, 4 ... chunks."""
    met = table.join(_shifted(table, 1, truth="first"), _PLACE, "left")
    open_ = written(met.where(F.col("truth") != F.col("end")).select(*KEY).distinct(), "open")
    if open_.isEmpty():
        return table.drop("first")
    chunks = table.drop("first").join(open_, KEY, "left_semi")
    jump = written(_per_chunk(chunks, "m", "array<long>", ["letters"], matrix).select(*_PLACE, "m", "last"), "matrices")
    step = 1
    while not jump.where("NOT last").isEmpty():  # m leads over the next `step` chunks, or to the end
        far = _shifted(jump, step, m2="m", last2="last")
        joined = jump.join(far, _PLACE, "left")
        more = ~F.col("last") & F.col("m2").isNotNull()
        columns = [F.when(more, _product(F.col("m"), F.col("m2"))).otherwise(F.col("m")).alias("m"), F.when(more, F.col("last2")).otherwise(F.lit(True)).alias("last")]
        jump = written(joined.select(*_PLACE, *columns), "matrices")
        step *= 2
    final = [min(x, FAR) for x in END]
    first = F.array(*[F.array_min(F.array(*[F.get("m", F.lit(4 * q + k)) + final[k] for k in range(4)])) for q in range(4)])
    level_ = F.transform(first, lambda x: x - F.array_min(first))
    settled = _shifted(jump.select(*_PLACE, level_.alias("first")), 1, truth="first")
    ends = chunks.join(settled, _PLACE, "left").select(*_PLACE, "letters", "last", F.coalesce("truth", "end").alias("end"))
    return written(table.drop("first").join(open_, KEY, "left_anti").unionByName(ends), "settled")


def enter_states(ends: DataFrame) -> DataFrame:
    """``conv, no_conv, chunk, letters, last, end, state``: the state that the cheapest edits enter each chunk in."""
    ways = _per_chunk(ends, "way", "array<int>", ["letters", "end", "last"], lambda letters, end, last: [trace(letters, end, q, last)["state"] for q in range(4)])
    ways = written(ways.drop("letters"), "ways")
    # from the state some chunks before to the state at a chunk's start; a conversation starts in state 0
    jump = ways.select(*_PLACE).join(_shifted(ways, -1, way="way"), _PLACE, "left").withColumn("start", F.col("way").isNull())
    jump = written(jump.withColumn("way", F.coalesce("way", F.array(*[F.lit(0)] * 4))), "jumps")
    step = 1
    while not jump.where("NOT start").isEmpty():
        back = _shifted(jump, -step, way2="way", start2="start")
        joined = jump.join(back, _PLACE, "left")
        more = ~F.col("start") & F.col("way2").isNotNull()
        composed = F.transform("way2", lambda q: F.get(F.col("way"), q))
        columns = [F.when(more, composed).otherwise(F.col("way")).alias("way"), F.when(more, F.col("start2")).otherwise(F.lit(True)).alias("start")]
        jump = written(joined.select(*_PLACE, *columns), "jumps")
        step *= 2
    return ends.join(jump.select(*_PLACE, F.get("way", F.lit(0)).alias("state")), _PLACE)


_CONVERSATION = (
    "conv long, no_conv boolean, blank long, duplicate long, truncated long, illegal long, low long, high long, "
    "turns long, cost long, audit string, repaired_sha256 string"
)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by conversation and place -> a row per conversation.

    Texts pass by a chunk at a time: a digest needs all of a conversation in
    order, but never together.
    """
    now: dict | None = None

    def close() -> dict:
        now["audit"] = "".join(now.pop("edits"))
        now["repaired_sha256"] = now.pop("sha").hexdigest()
        del now["any"], now["closes"], now["last_turn"]
        return now

    def take(r: dict) -> None:
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            now[c] += r[c]
        if now["closes"] is not None and now["closes"] + r["opens"] not in ("su", "ua", "au"):
            now["illegal"] += 1
        if r["low"] is not None:
            now["turns"] -= r["low"] == now["last_turn"]
            now["low"] = r["low"] if now["low"] is None else now["low"]
            now["high"] = now["last_turn"] = r["high"]
        now["closes"] = r["closes"]
        now["cost"] += r["edits"]["cost"]
        now["edits"].append(r["edits"]["edits"])
        state, k = r["state"], 0
        for edit in r["edits"]["edits"]:
            if edit == "D":
                k += 1
                continue
            if edit == "I":
                line, state = f"{NAME[ROLE[state]]}:", ONWARD[state]
            elif edit == "R":
                line, state, k = f"{NAME[ROLE[state]]}:{r['texts'][k]}", ONWARD[state], k + 1
            else:
                line, state, k = f"{r['roles'][k]}:{r['texts'][k]}", NEXT[state, r["roles"][k][0]], k + 1
            now["sha"].update((("\n" if now["any"] else "") + line).encode())
            now["any"] = True

    schema = pa.schema([(c, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[k]) for c, k in (x.split() for x in _CONVERSATION.split(", "))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or (now["conv"], now["no_conv"]) != (r["conv"], r["no_conv"]):
                if now is not None:
                    out.append(close())
                now = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0)
                now |= {"conv": r["conv"], "no_conv": r["no_conv"], "low": None, "high": None, "last_turn": None}
                now |= {"closes": None, "edits": [], "sha": hashlib.sha256(), "any": False}
            take(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([close()], schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows (conv_id, turn, role, text)``: what is wrong with it, and its cheapest repair.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost`` (long),
    ``audit``, the edits' initials (of equal cost the least as ASCII), and
    ``repaired_sha256`` of the repaired ``role:text`` lines.

    * Rows without a conversation are one conversation with a null id.
    * Rows without a turn come first.  Rows of one turn go by role, then by the
      MD5 digest of their text; equal rows stay apart, and later ones are
      duplicates.
    * A null role or text counts as one space, so it is illegal or blank.
    * Conversations, and texts, of any length: a chunk's texts are in memory
      together, a conversation's never are, but its audit is one string.
    * Other columns are not read; a table without rows gives none.
    """
    pieces = written(chunked(faults(in_order(rows))), "chunks")
    entered = enter_states(end_vectors(pieces)).select(*_PLACE, "end", "state", "last")
    parts = pieces.join(entered, _PLACE)
    parts = _per_chunk(parts, "edits", "struct<state:int,cost:long,edits:string>", ["letters", "end", "state", "last"], trace)
    parts = parts.drop("letters", "end", "last").repartition(*KEY).sortWithinPartitions(*_PLACE)
    done = parts.mapInArrow(_stitch, _CONVERSATION)
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    conv = F.when(~F.col("no_conv"), F.col("conv"))
    return done.select(conv.alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """:func:`repair` of the damaged rows, with a row for every conversation of ``rows``.

    A conversation that the damage leaves no row has zeros, an empty audit and
    the digest of the empty text.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    found = repair(damage(rows)).withColumnRenamed("conv_id", "found")
    all_ = rows.select("conv_id").distinct()
    joined = all_.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").drop("found")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return joined.select("conv_id", *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in joined.columns[1:]])
