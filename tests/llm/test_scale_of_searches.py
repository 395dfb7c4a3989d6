import numpy as np
from pyspark.sql import functions as F
from tallyfield.llm import ball_tree, decontaminate, warc


def test_best_first_visits_few_nodes():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 60
    x = np.rint(centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 16)) * 3).astype(np.int64)
    tree = ball_tree.build_tree(np.arange(6000), x, leaf=32)
    for q in range(0, 200, 20):
        best = ball_tree.Best(np.array([q]), x[[q]], 6)
        best.search(tree)
        want = sorted(((-int(x[q] @ x[j]), j) for j in range(6000) if j != q))[:5]
        assert [(-s, i) for s, i in zip(*(side[0] for side in best.without_own()))] == want
        assert best.visited < 0.5 * len(tree["child"])


def test_a_large_benchmark_is_one_pass(spark):
    rng = np.random.default_rng(9)
    vocabulary = np.array([f"w{i}" for i in range(30_000)])
    items = [(i, " ".join(vocabulary[rng.integers(30_000, size=300)])) for i in range(2700)]  # about 5 MB
    docs = [(i, "so " + " ".join(items[i * 7][1].split()[40:90]) + " and on") for i in range(60)] + [(100 + i, " ".join(vocabulary[rng.integers(30_000, size=200)])) for i in range(60)]
    found = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for r in found.collect():
        assert [tuple(m) for m in r["matches"]] == ([(str(r["doc_id"] * 7), 1, 40, 50)] if r["doc_id"] < 100 else [])


def test_blocks_beyond_the_held_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD", 1)
    items = [(i, " ".join(f"{i}x{j}" for j in range(12))) for i in range(9)]
    files = decontaminate.blocks(spark.createDataFrame(items, "item_id long, text string"), 10, 100)
    every = decontaminate._each(files)
    for _ in range(2):
        assert sorted(i for t in every() for i in t.ids) == [str(i) for i in range(9)]


def test_half_of_the_records_share_a_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "SALT_ROWS", 10)
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, F.lit("é" * 600)).otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("html"))
    archive = warc.write_archive(rows)
    assert archive.headers.groupBy("sha256", "salt").count().agg(F.max("count")).first()[0] < 40 and archive.payloads.count() == 201
    got = warc.read_records(archive)
    assert got.count() == 400 and got.where("record_type = 'revisit' and refers_to = 398").count() == 199
    assert got.where((F.col("page_id") % 2 == 0) & (F.octet_length("payload") != 1200)).count() == 0
