import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import docs, empty, rows, tuples
from tilth.llm.encoding import Encoder
from tilth.llm.token_files import TokenFile, pack, token_file_digest


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_encoder_is_the_library(name, cut):
    texts = [t or "" for _, t in rows()]
    own, plain = Encoder(P.path(name), cut, keep=500), library(name)
    for _ in range(2):  # once new, once remembered
        for got, text in zip(own.encode(texts), texts, strict=True):
            assert got.tolist() == plain(text)


TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'.,aBé\xa0\x1c\x00\x01İ​")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_encoder_on_any_text(texts):
    for name, cut in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")):
        own, plain = coders(name, cut)
        assert [x.tolist() for x in own.encode(texts)] == [plain(t) for t in texts]


@cache
def coders(name, cut):
    return Encoder(P.path(name), cut), library(name)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1200), max_size=5))
def test_file_round_trip(lists):
    ids = [np.array(x, np.uint32) for x in lists]
    f = TokenFile(pack(np.concatenate([*ids, np.zeros(0, np.uint32)]), [None, *range(1, len(ids))][: len(ids)], np.array([len(x) for x in ids], int)))
    assert [f.document(i).tolist() for i in range(len(ids))] == lists
    flat = [x for y in lists for x in y]
    assert [f.get(i) for i in range(len(flat))] == flat
    assert f.range(3, len(flat) - 2).tolist() == flat[3 : max(3, len(flat) - 2)]


def test_query_against_the_library(spark):
    pairs, plain, at, want = rows(), library("word_bpe_49k.json"), 0, []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = np.array([*plain(t or ""), 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_file_digest(docs(spark, pairs), P.path("word_bpe_49k.json"))
    assert tuples(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_empty(spark):
    assert token_file_digest(empty(spark), P.path("word_bpe_49k.json")).collect() == []
