import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyfield.llm import byte_pairs as bp

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def library(content):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


REAL = library(bp.content_of(PATH))
#: Tokens whose ranks aren't in the order of merges: a merged token may be in pairs of lower rank.
ODD = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([b"abab", b"aba", *(bytes([b]) for b in range(256)), b"ab", b"aa", b"ba", b"aaa", b"bab", b"aaaa"]))


def encoded(content, texts):
    met = bp.Pieces(bp.vocabulary(content))
    import regex

    pieces = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    return [met.of(ps)[0].tolist() for ps in pieces]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab \n'st1é中", max_size=300), max_size=8), st.sampled_from([3, 256]))
def test_tokens_equal_the_library_s(texts, wide):
    for content, lib in ((bp.content_of(PATH), REAL), (ODD, library(ODD))):
        old, bp.WIDE = bp.WIDE, wide
        try:
            assert encoded(content, texts) == [lib.encode_ordinary(t) for t in texts]
        finally:
            bp.WIDE = old


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=6))
def test_several_pairs_in_a_round_are_those_of_one_by_one(words):
    lib = library(ODD)
    for bp.WIDE in (2, 256):
        tokens, counts = bp.vocabulary(ODD).encode([w.encode() for w in words])
        assert tokens.tolist() == [t for w in words for t in lib._encode_single_piece(w)] and counts.sum() == len(tokens)


def test_long_pieces():
    texts = ["a" * 50_000, " " * 30_000 + "x", "天地玄黄宇宙洪荒" * 3000, "ab" * 20_000]
    assert encoded(bp.content_of(PATH), texts) == [REAL.encode_ordinary(t) for t in texts]


def test_hash_table_holds_every_pair():
    words = bp.vocabulary(bp.content_of(PATH))
    left, right = np.array([[words.ranks[t[:1]], words.ranks[t[1:]]] for t in words.ranks if len(t) == 2]).T
    assert words.pairs.find(left, right).tolist() == [words.ranks[t] for t in words.ranks if len(t) == 2]


def test_missing_bytes_are_an_error():
    with pytest.raises(ValueError, match="no token"):
        bp.Vocabulary({b"a": 0})


def test_query_equals_the_library_on_the_whole_table(spark):
    got = {r.doc_id: tuple(r)[1:] for r in bp.op13_matrix_byte_pairs(spark, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = REAL.encode_ordinary(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    assert not got


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "<|endoftext|> x", "c"), (2, "y" * 300_000, "d"), (2, "z", "e"), (2, "z", "e")], "doc_id long, text string, ids string")
    rows = bp.decode(bp.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in rows) == sorted((str(d), t or "") for d, t, _ in docs.collect())
    assert bp.encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [60_000]), (3, [1, None]), (4, []), (5, [0, 1])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded if r.decoded is None else bytes(r.decoded) for r in bp.decode(lists, PATH).collect()} == {1: None, 2: None, 3: None, 4: b"", 5: REAL.decode_bytes([0, 1])}
