import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.llm import decontaminate, mixing, near_copies, pii, quality

CLASHES = "expected_grade tail selected n_words hits matches _pii row k1 k2 unit head first n key fp copies taken size hash aside0_hits id v".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 2 else "web", len(t or "")) for i, t in enumerate([None, "", "one two three four five six seven", "write to ann@example.com today", "one two three four five six seven", "a passage of ten words that the benchmark holds as well"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))


def same(docs, out, but=("text", "n_chars", "copies", "taken")):
    assert [c for c in out.columns if c not in but] == [c for c in docs.columns if c not in but]
    held = [c for c in docs.columns if c not in but]
    assert out.select(*(F.col(f"`{c}`") for c in held)).exceptAll(docs.select(*(F.col(f"`{c}`") for c in held))).count() == 0
    return sorted(r["doc_id"] for r in out.collect())


def test_stages_keep_columns_of_any_name(spark, docs):
    benchmark = spark.createDataFrame([("b", "A passage of ten words that the benchmark holds as well")], "item_id string, text string")
    everything = quality.Model(np.zeros(quality.WIDTH, dtype=np.float32), np.array([-1e3]))
    nothing = quality.Model(np.zeros(quality.WIDTH, dtype=np.float32), np.array([1e3]))
    assert same(docs, quality.keep(docs, everything)) == list(range(6)) and same(docs, quality.keep(docs, nothing)) == []
    assert same(docs, near_copies.keep_first(docs)) == [0, 2, 3, 5]
    assert same(docs, decontaminate.decontaminate(docs, benchmark)) == [0, 1, 2, 3, 4]
    redacted = pii.redact(docs)
    assert same(docs, redacted) == list(range(6)) and redacted.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in redacted.collect()}[3] == "write to <EMAIL> today"
    assert set(same(docs, mixing.take(docs))) <= {2, 3, 4, 5}
