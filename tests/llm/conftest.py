import pytest

from buzzscore.llm.common import written

@pytest.fixture
def make(spark):
    """``make(texts, ids)``: documents with nulls and with columns that have the operators' names."""

    def build(texts, ids=None, parts=3):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, None if k % 4 == 3 else "en", None if k % 5 == 4 else f"src{k}", k) for k, (i, t) in enumerate(zip(ids, texts))]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rk int")
        for name in ("n_lines", "score", "predicted", "item_ids", "kept", "data", "marks", "done", "found", "licenses", "tokens", "epoch"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return written(df.repartition(parts, "rk") if texts else df, "made")

    return build
