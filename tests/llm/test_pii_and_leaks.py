import hashlib
import re
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
from brute import contaminated
from pyspark.sql import functions as F
from tallyfield.llm import chain, decontaminate, pii
from tallyfield.llm.pii_examples import held_table

SF = "/root/testdata/sf0.001"


def plain_base(text):
    """The patterns as they stand."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in email.finditer(text)]
    out += [("ip", *m.span()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in card.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("text", ["a@b.c%d@e.f", "x@y @z.w a.b@c", "1.2.3.4.5.6.7.8 and 300.1.1.1.9", "4111 1111-1111 1111 +1 (555) 010-4477 12", "+1-2-3 +44 20 7946 0958.", "a@b@c.d.e-f g@h..i", ""])
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_adds_spans_and_cuts_are_exact():
    decoder = pii.Decoder(pii.learned())
    assert decoder.reach
    whole = pii.Decoder(pii.learned())
    whole.reach = None
    fill = "the house was on of it and " * 30
    texts = [fill + x + " " + fill + y for x in ("(988) 555-2485", "123-45-6789.", "jane dot doe at mail dot org", "at", "dot, dot") for y in ("312-555-0107", "", "2021-03-04 x@y.org")]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").fetchall()]
    assert decoder.labels(texts) == whole.labels(texts)
    kinds = [pii.added_spans(t, lab, pii.base_spans(t))[0][0] for t, lab in zip(texts[:9:3], decoder.labels(texts[:9:3]))]
    assert kinds == ["tel", "ssn", "mail"]


def spans_of(row, labels):
    out, last = [], None
    for i, y in enumerate(labels):
        if y and last == (i - 1, y):
            out[-1][2] = i
        elif y:
            out.append([y, i, i])
        last = (i, y) if y else None
    return {tuple(s) for s in out}


def test_recall_and_precision_on_the_held_out_table():
    decoder, rows = pii.Decoder(pii.learned()), held_table()
    found, wanted, right = Counter(), Counter(), Counter()
    for row, labels in zip(rows, decoder.labels([" ".join(w for w, _ in r) for r in rows])):
        got = spans_of(row, [pii.LABELS[dict(labels).get(i, 0)] for i in range(len(row))])
        want = spans_of(row, [y for _, y in row])
        for counter, spans in ((found, got), (wanted, want), (right, got & want)):
            counter.update(s[0] for s in spans)
    assert set(wanted) == set(pii.LABELS[1:])
    for kind in wanted:
        assert right[kind] >= 0.9 * wanted[kind] and right[kind] >= 0.95 * found[kind], (kind, right[kind], wanted[kind], found[kind])


def test_plain_cases():
    decoder = pii.Decoder(pii.learned())
    cases = {"555 123 4567": "tel:0:12", "Call 2125550142 now": "tel:5:15", "ssn 123 45 6789": "ssn:4:15", "joe at gmail dot com": "mail:0:20", "password=b7db7aa4a5fcc78305 x": "secret:9:27", "we met at noon, dot": "", "version 3.2.1 of 2019": ""}
    for text, want in cases.items():
        spans = pii.added_spans(text, decoder.labels([text])[0], pii.base_spans(text))
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in spans) == want, text


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    emit, trans, zero = rng.normal(size=(5, 20, 3)), rng.normal(size=(3, 3)), np.zeros((20, 3))
    best = chain.viterbi(emit, trans, np.full(20, 5), zero, zero)
    for n in range(20):
        score = lambda p: sum(emit[t, n, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(best[:, n]) == max(product(range(3), repeat=5), key=score)


def test_pii_over_whole_table_and_odd_rows(spark):
    got = {r["doc_id"]: r for r in pii.op1_pii_crf(spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        want = plain_base(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert got[i]["n_email"] == sum(s[0] == "email" for s in want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i]["spans"].split(","))
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "é a@b.cd " + "x" * 100_000, 5), (3, "é a@b.cd", 5), (None, "(988) 555-2485", 5)], "doc_id long, text string, pii int")
    found = {(r["doc_id"], len(r["text"] or "")): [tuple(s)[:3] for s in r["pii"]] for r in pii.find_pii(odd).collect()}
    assert found[3, 8] == [("email", 2, 8)] and found[1, 0] == [] and found[None, 14] == [("tel", 0, 14)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(odd.where("doc_id is null or length(text) < 20 or text is null").drop("pii")).collect()}
    assert clean == {1: None, 2: "", 3: "é <EMAIL>", None: "<TEL>"}
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = sorted(map(tuple, decontaminate.op2_suffix_decontamination(spark, SF).collect()))
    assert got == sorted(contaminated(docs, items)) and any(r[5] for r in got)


@pytest.mark.parametrize("chars", [120_000, 40])
def test_decontamination_of_odd_rows(spark, chars):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None, 0), (2, "", 0), (3, "say Tiny Item, twice: tiny item tiny item", 0), (4, long + " " + long, 0), (4, long + " " + long, 0), (5, " ".join(f"w{i}" for i in range(9)), 0), (6, "alone", 0)]
    items = [(1, "tiny item"), (2, None), (3, "!!"), (4, " ".join(f"w{i}" for i in range(5, 18))), (5, "item tiny"), (5, "item tiny"), (10, "alone")]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string, hits int"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(docs_df, items_df, block_chars=chars)
    got = [(r["doc_id"], r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), [m["item_id"] for m in r["matches"]]) for r in found.collect()]
    want = contaminated([d[:2] for d in docs], items)
    assert sorted((g[0], g[1], g[2], hashlib.sha256(",".join(sorted(g[3])).encode()).hexdigest()) for g in got) == sorted((w[0], w[1], w[2], w[4]) for w in want)
    longest = [m for r in found.where("doc_id = 4").collect() for m in r["matches"]]
    assert {(m["start"], m["item_start"], m["words"]) for m in longest} == {(5, 0, 13)}
    assert sorted(r[0] for r in decontaminate.decontaminate(docs_df, items_df).collect()) == [1, 2, 5]
    assert decontaminate.find_matches(docs_df, items_df.limit(0)).where(F.size("matches") > 0).count() == 0
    assert decontaminate.find_matches(docs_df.limit(0), items_df).count() == 0


def test_an_item_of_very_many_distinct_words(spark):
    item = " ".join(f"v{i}" for i in range(70_000))
    part = " ".join(f"v{i}" for i in range(69_000, 69_040))
    docs = spark.createDataFrame([(1, "so " + part), (2, "v1 v2 v3"), (3, "v0 v69999 " * 9)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_matches(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert [tuple(m) for m in found[1]["matches"]] == [("a", 1, 69_000, 40)] and not found[2]["hits"] and not found[3]["hits"]
