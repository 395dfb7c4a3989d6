import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.llm import ball_tree, chain, language, quality, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """id -> smallest id reachable, of (id, fingerprint) pairs."""
    out = {}
    for i, fp in pairs:
        out.setdefault(i, i)
    change = True
    while change:
        change = False
        for (i, a), (j, b) in combinations(pairs, 2):
            if (a ^ b).bit_count() <= 4 and out[i] != out[j]:
                out[i] = out[j] = min(out[i], out[j])
                change = True
    return out


def test_shared_positions_name_themselves_by_triples():
    for n in range(4, 9):
        for some in combinations(range(8), n):
            assert set().union(*(t for t in simhash.TRIPLES if set(t) <= set(some))) == set(some)


def test_groups_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash_groups(spark, SF).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    least = plain_components(prints)
    assert got == {i: (f"{fp:016x}", least[i]) for i, fp in prints}


@pytest.mark.parametrize("short, long", [(32, 4096), (10_000, 20_000), (1, 4096), (4, 8)])
def test_links_join_all_that_brute_force_joins(spark, short, long):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):  # chains and dense groups
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
        fps |= {x ^ (1 << b) for b in range(20)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, short=short, long=long)).collect()}
    least, group = plain_components(list(enumerate(fps))), {}
    for i, x in enumerate(fps):
        group.setdefault(least[i], set()).add(roots.get(signed(x), signed(x)))
    assert all(len(g) == 1 for g in group.values()) and len({next(iter(g)) for g in group.values()}) == len(group)


def test_near_groups_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, 1), (3, text.upper(), 1), (3, text.upper(), 1), (7, None, 1), (6, "", 1), (None, text, 1), (9, "a b", 1), (8, "a\tB", 1), (2, "x " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == [(-1, 3), (2, 2), (3, 3), (3, 3), (5, 3), (6, 6), (7, 6), (8, 8), (9, 8)]
    assert sorted((r["doc_id"] or -1) for r in simhash.keep_first(docs).collect()) == [2, 3, 6, 8]
    other = " ".join(f"v{i}" for i in range(200))
    twice = spark.createDataFrame([(3, text), (5, text), (5, other), (9, other + " x"), (3, text + " y"), (None, text), (None, text + " z"), (None, "alone"), (None, "alone")], "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(twice).collect()), key=str)
    assert len(kept) == 3 and (5, other) in kept and (None, "alone") in kept and kept[0][0] == 3
    assert simhash.near_groups(docs.limit(0)).count() == 0


def plain_top(rows, k):
    q = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    return {i: sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i])))[:k] for i in q if i % 20 == 0}


@pytest.mark.parametrize("shard", [7, 4096])
def test_top_k_of_odd_rows(spark, shard):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 260)]  # many equal vectors: ties
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (360, [1.0, 2.0]), (361, [3.0, 4.0]), (None, [1.0] * 6), (380, [1e7] * 6), (400, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ball_tree.top_k(df, df.where("vec_id % 20 = 0"), k=5, shard_rows=shard, block=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    assert {q: [x[i] for i in sorted(x)] for q, x in got.items()} == {q: x for q, x in plain_top(rows, 5).items() if x}
    assert ball_tree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_a_query_meets_rows_of_its_id_but_not_itself(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.25]), (40, [1.0, 0.0]), (40, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ball_tree.top_k(df, df.where("vec_id % 20 = 0"), k=3).collect())
    q = [(i, [int(64 * x) for x in v]) for i, v in rows]
    want = []
    for n, (i, v) in enumerate(q):
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(q) if m != n)[:3]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    length = np.array([4])
    paths = {p: sum(emit[t, 0, p[t]] for t in range(4)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in product(range(3), repeat=4)}
    z = np.log(sum(map(np.exp, paths.values())))
    log_z, post, pairs = chain.forward_backward(emit, trans, length)
    want = np.array([[sum(np.exp(s - z) for p, s in paths.items() if p[t] == k) for k in range(3)] for t in range(4)])
    assert np.allclose(log_z, z) and np.allclose(post[:, 0], want) and np.isclose(pairs.sum(), 3)
    whole, moves = chain.whole_marginals(emit[:, 0], np.zeros(4, dtype=int), trans, block=2)
    assert np.allclose(whole, want) and np.allclose(moves, pairs)
    zero = np.zeros((1, 3))
    assert tuple(chain.viterbi(emit, trans, length, zero, zero)[:, 0]) == max(paths, key=paths.get)


def test_language_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op9_language_crf(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.97 * len(got)


def test_language_of_odd_rows(spark):
    en, de = "the of and that with this from other there", "der die und nicht sich eine auch werden über"
    rows = [(1, en, "en"), (2, de, "de"), (3, None, "en"), (4, "", None), (5, "12 !? 3", "en"), (6, en + " " + de, None), (6, en + " " + de, None), (7, "der " * 50_000, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model, runs=True).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[7]["lang_pred"]) == ("en", "de", "de")
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5))
    assert [r["lang"] for r in got[6]["runs"]] == ["en", "de"] and sum(r["words"] for r in got[6]["runs"]) == 18
    none = language.fit(docs.limit(0))
    assert language.identify(docs, none).where("lang_pred <> 'und'").count() == 0 and language.identify(docs.limit(0), model).count() == 0


def test_quality_ranks_ratings_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"), quality.grade_of_labels())
    seen = quality.rate(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("quality", "toxic").agg(F.avg("expected_grade").alias("g"), F.avg("tail").alias("t")).collect()
    by = {(r["quality"], r["toxic"]): (r["g"], r["t"]) for r in seen}
    assert by[1, 0][0] > by[1, 1][0] and by[1, 0][0] > by[0, 0][0] + 0.5 and by[1, 0][1] > 0.85


def test_quality_of_odd_rows(spark):
    rows = [(i, "fine calm words here" if i % 2 else "BAD!! LOUD!! JUNK!!", 9) for i in range(40)] + [(90, None, 9), (91, "", 9), (92, "fine " * 50_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tail int")
    ratings = spark.createDataFrame([(i, i % 2 * 2 if i % 5 else None) for i in range(40)] + [(None, 1), (500, 1), (0, 0), (0, 0)], "doc_id long, grade int")
    model = quality.fit(docs, ratings, F.col("grade"))
    got = {r["doc_id"]: r for r in quality.rate(docs, model).collect()}
    assert got[1]["selected"] and got[92]["selected"] and not got[2]["selected"] and got[1]["expected_grade"] > got[2]["expected_grade"] and 90 in got and 91 in got
    flat = quality.fit(docs, ratings.where("grade = 2"), F.col("grade"))
    assert quality.rate(docs, flat).where("selected").count() == len(rows)
    assert quality.rate(docs.limit(0), quality.fit(docs.limit(0), ratings.limit(0), F.col("grade"))).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = p.land(stage(spark, seen, sf), name)
        assert out.columns == docs.columns and 0 < out.count() <= seen.count()
        seen = out
    assert seen.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
    last = p.run(spark, sf).collect()
    assert {r["doc_id"] for r in last} <= {r["doc_id"] for r in seen.collect()} and all(1 <= r["copies"] <= 3 for r in last)


def test_each_step_of_the_index_removes_pairs(spark):
    """Pairs that meet share three bytes, those of the minimum tally four, and verified ones differ in four bits at most: counted against all pairs."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    fps = [base]
    for flips, times in ((3, 2), (4, 2), (6, 3), (12, 3), (20, 3)):
        for _ in range(times):
            some = base.copy()
            for _ in range(flips):
                some ^= np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)
            fps.append(some)
    fps = np.unique(np.concatenate(fps))
    differ = fps[:, None] ^ fps[None, :]
    shared = (differ.view(np.uint8).reshape(len(fps), len(fps), 8) == 0).sum(2)
    upper = np.triu(np.ones_like(shared, dtype=bool), 1)
    want = [int((upper & (shared >= 3)).sum()), int((upper & (shared >= 4)).sum()), int((upper & (np.bitwise_count(differ) <= 4)).sum())]
    lists = simhash.short_lists(simhash.indexed(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")), 1000)
    passes = simhash.steps(simhash.BITS)
    assert [simhash.met(lists, *passes[:k]).count() for k in range(3)] == want
    assert want[0] > want[1] > want[2] > 60
