import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from entloom.llm.bpe_tree import TreeCodec, bpe_encode, read_ranks
from tests.llm.conftest import ODD

FILE = P.path("byte_bpe_multi_50k.tiktoken")
with open(FILE, "rb") as f:
    RANKS = read_ranks(f.read())
LIB = tiktoken.Encoding("lib", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TINY = TreeCodec(RANKS, P.PATTERN, leaf_chars=4, leaf_bytes=4)
SMALL = TreeCodec(RANKS, P.PATTERN, leaf_chars=16, leaf_bytes=64, cache=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'stlmredv \n\t12é中.!  \x1c\x85\xa0²Ⅷ😀", max_size=80))
def test_equals_library(text):
    want = LIB.encode_ordinary(text)
    for codec in (TINY, SMALL):
        assert codec.encode(text) == want
        assert codec.decode(want) == text.encode()


def test_long_matches():
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice("abcdeétionhs") for _ in range(rng.randint(100, 3000)))
        assert TINY.merge(text.encode()) == LIB.encode_ordinary(text)


def test_a_match_of_a_million_characters():
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshr") for _ in range(1_000_000))
    codec = TreeCodec(RANKS, P.PATTERN)
    ids = codec.encode(text)
    assert ids == LIB.encode_ordinary(text) and codec.decode(ids) == text.encode()


@given(st.text(alphabet="abé1", min_size=257, max_size=600))
@settings(max_examples=30, deadline=None)
def test_both_mergers_agree(text):
    data = text.encode()
    ids = SMALL._merge_heap(data)
    assert ids == LIB.encode_ordinary(text) or len(SMALL.split(text)) > 1
    assert SMALL.decode(ids) == data


def test_matches_join_at_any_cut():
    text = "don't  stop\n\n  now   12ab's  'll   "
    for cut in range(len(text) + 1):
        left, right = (LIB and SMALL._find(t) for t in (text[:cut], text[cut:]))
        assert SMALL.join_matches(left, right) == SMALL._find(text)


def test_table(spark, odd_docs, make_docs):
    rows = bpe_encode(odd_docs, FILE, P.PATTERN).collect()
    assert len(rows) == len(ODD)
    want = sorted((str(i), len(LIB.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in rows) == want
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    assert bpe_encode(make_docs([]), FILE, P.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["", "a", " " * 100, "\n" * 50 + "x"])
def test_edges(text):
    assert TINY.encode(text) == LIB.encode_ordinary(text)
