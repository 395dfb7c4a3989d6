import random

import pytest
from compare import differences
from tallyfield.llm import mixing

SCHEMA = "doc_id long, text string, source string, copies int"


def by_source(rows):
    out = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + r["taken"]
    return out


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i // 3, lambda i: i if i % 2 else None])
def test_targets_hold_with_null_and_repeated_ids(spark, ids):
    rng = random.Random(1)
    rows = [(ids(i), "w " * rng.randint(1, 9), "a" if i < 1200 else "b", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(docs).collect()
    target = {r["source"]: r["target"] for r in got}
    assert len(got) == len(rows)
    for source, words in by_source(got).items():
        assert abs(words - target[source]) <= 9
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_equal_rows_are_spread(spark):
    rows = [(1, "same words here", "a", 1)] * 900 + [(i, "some other words", "b", 1) for i in range(2, 1102)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    words, target = by_source(got), {r["source"]: r["target"] for r in got}
    assert all(abs(words[s] - target[s]) <= 3 for s in target)


def test_take_returns_the_taken_rows_whole(spark):
    rows = [(i % 40 if i % 9 else None, f"t{i} " * (i % 7), ("x", "y", None)[i % 3], 5) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed, took = mixing.mix(docs).collect(), mixing.take(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["copies"], r["taken"]) for r in mixed if r["copies"]) == sorted((str(r["doc_id"]), str(r["source"]), r["copies"], r["taken"]) for r in took)
    texts = {(r[0], r[1], r[2]) for r in rows}
    assert all((r["doc_id"], r["text"], r["source"]) in texts and r["taken"] == r["copies"] * len(r["text"].split()) for r in took)
    assert mixing.take(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [3, 1000])
def test_repeated_ids_equal_the_sql(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    rng = random.Random(2)
    data = [(rng.choice([None, 1, 2, *range(3, 40)]), "w " * rng.randint(0, 6), rng.choice(["a", "b", "c", None]), 1) for _ in range(400)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert differences(spark, mixing.QUERIES["op10_fair_queue_mix"], mixing.ORACLE["op10_fair_queue_mix"], str(tmp_path)) is None
