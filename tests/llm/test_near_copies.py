import random
from itertools import combinations

import corpus_pipeline
import pytest
from tallyfield.llm import near_copies


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(docs):
    sets, out = {i: grams(t) for i, t in docs}, {i: i for i, _ in docs}
    for i, j in combinations(sets, 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((out[i], out[j]))
            out = {k: a if v == b else v for k, v in out.items()}
    return out


def fixture():
    """Pairs on both sides of 0.8, and a group of 60 near copies of one text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    docs = []
    for changed in (1, 2, 3, 4, 5, 6, 8, 12) * 4:
        w = [word() for _ in range(200)]
        v = list(w)
        for k in range(changed):
            v[3 + 200 // changed * k] = word()
        docs += [" ".join(w), " ".join(v)]
    w = [word() for _ in range(200)]
    for k in range(60):
        docs.append(" ".join([*w[:k], word(), *w[k + 1 :]]))
    return list(enumerate([*docs, "one two", "One  two", "", None], 1))


@pytest.mark.parametrize("small, part", [(8, 256), (2, 4)])
def test_groups_equal_brute_force(spark, small, part):
    docs = fixture()
    got = near_copies.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), small=small, part=part)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == plain_groups([(i, t or "") for i, t in docs])


def test_stage_keeps_one_of_each_group(spark):
    docs = fixture()
    rows = spark.createDataFrame([*docs, docs[0], (None, docs[0][1])], "doc_id long, text string")
    got = sorted(r["doc_id"] or 0 for r in corpus_pipeline.keep_first_copy(spark, rows, "").collect())
    assert got == sorted(set(plain_groups([(i, t or "") for i, t in docs]).values()))
    t, u = docs[0][1], docs[2][1]
    odd = spark.createDataFrame([(3, t, 1), (5, t, 1), (5, u, 1), (9, u + " x", 1), (3, t + " y", 1), (None, t, 1), (None, u, 2), (None, "alone", 1), (None, "alone", 1)], "doc_id long, text string, k1 int")
    kept = sorted(((r["doc_id"], r["text"]) for r in near_copies.keep_first(odd).collect()), key=str)
    assert len(kept) == 3 and (5, u) in kept and (None, "alone") in kept and kept[0][0] == 3
    assert corpus_pipeline.keep_first_copy(spark, rows.limit(0), "").count() == 0
