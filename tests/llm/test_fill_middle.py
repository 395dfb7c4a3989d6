import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyfield.llm import fill_middle as fim


def plain(id, text):
    """n, form, prefix_chars, middle_chars and output, from the definition."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.text("aZ <>PSM\né中\U0001f600", max_size=40), st.integers(1, 7))
def test_pieces_of_any_size_make_the_output_and_give_the_text_back(id, text, chunk):
    pieces = list(fim.cut(b"k", id, text.encode(), chunk=chunk))
    (n, form, prefix, middle), output = pieces[0][1][1:], b"".join(v for _, v in pieces[1:])
    assert (n, form, prefix, middle, output.decode()) == plain(id, text)
    for size in (1, 2, 5, 100):  # markers may be parted
        parted, got = fim.Parted(form), []
        for i in range(0, len(output), size):
            got += parted.take(output[i : i + size])
        got += parted.take(b"", last=True)
        assert b"".join(v for _, v in sorted(got)).decode() == text


def test_unit_starts_don_t_depend_on_blocks(monkeypatch):
    text = ("word 中éx9 ab" * 50).encode()
    whole = fim.Units(text)
    every = whole.offsets(fim.np.arange(whole.n + 1)).tolist()
    monkeypatch.setattr(fim, "BLOCK", 7)
    small = fim.Units(text)
    assert small.n == whole.n and small.offsets(fim.np.arange(whole.n + 1)).tolist() == every
    assert small.points(3, 40) == whole.points(3, 40)


TEXTS = [None, "", "one two three", "one two three", "a<P>b", "中文 text\n\n" * 9, "long words and more " * 20_000] + [f"text number {i}, with some words." for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 1 else None, t, "x", i) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "y", 0)] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, output_sha256 string, n int").repartition(3)


def test_rows_equal_the_definition(docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((r.doc_id, *(p := plain(r.doc_id, r.text))[:4], sha(p[4]), sha(r.text or "")) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in fim.digests(docs, chunk=5, partitions=4).collect()), key=str) == want
    got = fim.restored(fim.texts(docs, chunk=5)).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.restored)) for r in got), key=str) == want


def test_empty_table(docs):
    assert fim.digests(docs.where("false")).count() == 0


def test_restoration_sorts_without_a_second_shuffle(docs):
    outputs = fim.assembled(docs, partitions=4)
    again = outputs.mapPartitions(lambda x: x, preservesPartitioning=True).repartitionAndSortWithinPartitions(4, fim.partition_of)
    assert outputs.toDebugString().count(b"ShuffledRDD") == again.toDebugString().count(b"ShuffledRDD") == 1
