"""The corpus pipeline: stages, columns, planted cases, edge cases."""

import random

import pytest

import corpus_pipeline as P
from buzzscore.llm import queries as Q


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: clean documents, and planted ones of each kind."""
    r, d = random.Random(6), str(tmp_path_factory.mktemp("corpus"))
    item = words(r, 30).capitalize() + ". " + words(r, 12).capitalize() + "."
    rows, kinds = [], {}

    def add(kind, text):
        kinds[len(rows)] = kind
        rows.append((len(rows), text, "en", f"src{len(rows) % 4}", len(text or ""), "x"))

    for _ in range(120):
        add("clean", words(r, 60))
    for k in range(60):
        add("toxic", words(r, 20) + " vileword " + words(r, 10) + " foulword nastyword " + words(r, 10))
    base = words(r, 90)
    add("first", base)
    for _ in range(4):
        add("copy", base)
    for k in range(3):
        w = base.split()
        w[10 + 20 * k] = "changed"
        add("near", " ".join(w))
    for _ in range(3):
        add("leak", words(r, 40) + " " + item + " " + words(r, 25))
    lines = "\n".join(words(r, 8) for _ in range(5))
    add("first lines", words(r, 50) + "\n" + lines)
    add("repeated lines", words(r, 50) + "\n" + lines + "\n" + words(r, 50))
    for text in (None, "", "   "):
        add("blank", text)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, predicted string").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(k == "toxic")) for i, k in kinds.items() if k in ("toxic", "clean")]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, kinds, lines


def test_planted_cases(spark, corpus):
    d, kinds, lines = corpus
    docs = Q.read_table(spark, d, "documents")
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, d), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "predicted"]
        left = [kinds[x["doc_id"]] for x in docs.collect()]
        if name == "toxicity":
            assert "toxic" not in left and left.count("clean") == 120
        if name == "line_dedup":
            texts = {kinds[x["doc_id"]]: x["text"] for x in docs.collect()}
            assert lines in texts["first lines"] and lines.split("\n")[2] not in texts["repeated lines"]
            assert left.count("blank") == 3
        if name == "jaccard_join":
            assert "copy" not in left and "near" not in left and left.count("first") == 1
        if name == "decontamination":
            assert "leak" not in left
    assert left.count("clean") == 120 and left.count("first") == 1 and left.count("repeated lines") == 1
    out = P.STAGES[-1][1](spark, docs, d)
    assert out.columns == [*docs.columns, "domain", "tokens", "epoch"]
    assert out.count() > 0


def test_run_is_the_stages_in_order(spark, corpus):
    d, kinds, _ = corpus
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    begin = P.scratch_mark()
    got = P.run(spark, d)
    assert P.scratch_mark() == begin + 1  # only the result is left
    assert {kinds[x["doc_id"]] for x in got.collect()} <= {"clean", "first", "first lines", "repeated lines", "blank"}


@pytest.mark.parametrize("stage", P.STAGES, ids=lambda s: s[0])
def test_empty_and_null_tables(spark, corpus, stage):
    d, _, _ = corpus
    docs = Q.read_table(spark, d, "documents")
    assert stage[1](spark, P.written(docs.limit(0), "none"), d).count() == 0
    rows = [(None, None, None, None, None, None), (None, None, None, None, None, None), (1, "a b", None, "src1", 3, "x"), (1, "a b", None, "src1", 3, "x")]
    nulls = P.written(spark.createDataFrame(rows, docs.schema), "nulls")
    assert stage[1](spark, nulls, d).count() <= 8
