import random

import pytest
from tallyfield.operators.resolve import resolve, similar_names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def names():
    rng = random.Random(4)
    base = ["".join(rng.choice("abc d1&") for _ in range(rng.randint(1, 18))) for _ in range(60)] + ["aaaa", "aaaaa", "aaaab", "abababab", "babababa", "a", "ab", "b", "ohio state", "phio state", "iowa state"]
    changed = []
    for n in base:
        for _ in range(3):
            i = rng.randrange(len(n))
            changed.append(rng.choice([n[:i] + n[i + 1 :], n[:i] + "x" + n[i:], n[:i] + "c" + n[i + 1 :], "z" + n[1:]]))
    return base, base + changed


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_all_similar_pairs_are_found(spark, names, least):
    known, asked = names
    normal = lambda n: " ".join(n.split())
    want = {(a, k): round(1 - edits(a, k) / max(len(a), len(k)), 9) for a in {normal(x) for x in asked} for k in {normal(x) for x in known} if a != k and a and k}
    want = {p: s for p, s in want.items() if s >= least}
    assert any(a[0] != k[0] for a, k in want)
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs + [None, "", "!"]], f"{c} string")
    rows = similar_names(df(asked, "asked"), df(known, "name"), least).collect()
    assert len(rows) == len(want) and {(r.asked, r.name): round(r.score, 9) for r in rows} == want


def test_fields_popularity_aliases_and_missing_names(spark):
    teams = [(1, "Ohio", "Ohio Bobcats", "OHIO", None, "Bobcats"), (2, "Ohio State", "Ohio State Buckeyes", "OSU", "Ohio St", "Buckeyes"), (3, "Oregon State", "Oregon State Beavers", "OSU", "", "Beavers"), (3, "Oregon State", "x", "ORST", None, None), (4, "Buckeyes", None, None, None, "Ohio"), (None, "Nowhere", None, None, None, None)]
    entities = spark.createDataFrame(teams, "team_id long, location string, display_name string, abbr string, short_name string, name string")
    popular = spark.createDataFrame([(2, 5), (3, 9), (4, 50), (99, 1)], "team_id long, n long")
    aliases = spark.createDataFrame([("The  Buckeye-state!", "ohio state"), ("self", "zzz"), ("self", "osu")], "alias string, name string")
    asked = ["OHIO", "osu", "Buckeyes", "Phio State", "the buckeye state", "self", "Óhio", "unheard of", "", None, "OHIO"]
    rows = resolve(spark.createDataFrame([(a,) for a in asked], "asked string"), entities, popular, aliases).collect()
    assert {r.asked: (r.entity, r.how) for r in rows} == {
        "OHIO": (1, "exact"),  # its location, though team 4 is more popular
        "osu": (3, "exact"), "Buckeyes": (4, "exact"), "Phio State": (2, "fuzzy"), "the buckeye state": (2, "exact"),
        "self": (3, "exact"), "Óhio": (1, "exact"), "unheard of": (None, "none"), "": (None, "none"), None: (None, "none"),
    }
    assert len(rows) == 10 and resolve(entities.select("name").withColumnRenamed("name", "asked").where("false"), entities, popular).count() == 0


def test_posting_lists_stay_short(spark):
    """Names that share their common grams meet at rare ones only."""
    known = spark.range(3000).selectExpr("'state college number ' || lpad(cast(id * 7919 % 100000 as string), 5, '0') as name")
    asked = known.where("name like '%7'").selectExpr("'xtate' || substr(name, 6) as asked")
    rows = similar_names(asked, known, 0.95)
    assert {(r.asked[5:], r.name[5:]) for r in rows.collect()} == {(r.asked[5:], r.asked[5:]) for r in asked.collect()}


def test_numbered_names_that_share_their_pairs_of_digits_rarely_meet(spark):
    """Numbers use few different pairs of characters; only names that nearly match meet, most not more often than they have forms in common."""
    from tallyfield.operators.resolve import _by_forms, _formed

    known = spark.range(300).selectExpr("'ring ' || cast(10000 + id * 7919 % 90000 as string) as s").distinct().selectExpr("s", "length(s) as n")
    asked = spark.range(300).selectExpr("'ring ' || cast(100000 + id * 104729 % 900000 as string) as s").distinct().selectExpr("s", "length(s) as n")
    met = _by_forms(asked, known, 0.75, _formed(0.75)).count()
    pairs = {(r.asked, r.name) for r in similar_names(asked.selectExpr("s as asked"), known.selectExpr("s as name")).collect()}
    assert pairs == {(a, k) for (a,) in asked.select("s").collect() for (k,) in known.select("s").collect() if edits_within(a, k, 2)}
    assert len(pairs) <= met < 300 * 300 / 10


def edits_within(a, b, most):
    from collections import Counter

    return (Counter(a) - Counter(b)).total() <= most and edits(a, b) <= most
