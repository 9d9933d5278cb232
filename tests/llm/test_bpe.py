import base64
import hashlib
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import docs, empty, rows, tuples
from tilth.llm.bpe import Transducer, Utf8, codec, round_trip

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_the_library(library):
    own = codec(PATH, P.PATTERN)
    for _, t in rows():
        assert own.encode(t or "").tolist() == library.encode_ordinary(t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80) | st.text("abs'ing \nté", max_size=200))
def test_any_text(text):
    own = codec(PATH, P.PATTERN)
    ids = own.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert own.decode(ids) == text.encode() and "".join(own.stream(ids)) == text


LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_machine_alone_takes_any_bytes(data):
    own = codec(PATH, P.PATTERN)
    small = Transducer(own.vocabulary, most_states=5)
    assert b"".join(own.tokens[i] for i in small.encode(data)) == data
    assert own.machine.encode(data) == small.encode(data)


def test_one_long_match_is_read_once(library):
    own = codec(PATH, P.PATTERN)
    for text in ("a" * 20_000, "ab" * 10_000, "é" * 5_000, "aaab" * 4_000):
        assert own.machine.encode(text.encode()) == library.encode_ordinary(text)
    small = Transducer(own.vocabulary, most_states=50, lookahead=16)
    for text in (b"a" * 400_000, b"the" * 100_000):
        start = time.process_time()
        ids = small.encode(text)
        assert b"".join(own.tokens[i] for i in ids) == text and len(small.sets) <= 52 and time.process_time() - start < 20


@given(st.binary(max_size=12))
def test_utf8_machine(data):
    try:
        want = data.decode()
    except UnicodeDecodeError:
        want = None
    machine = Utf8()
    try:
        got = "".join(machine.feed(data[i : i + 1]) for i in range(len(data)))
        machine.end()
    except UnicodeError:
        got = None
    assert got == want


def test_query(spark, library):
    pairs, want = rows(), []
    for i, t in pairs:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = round_trip(docs(spark, pairs), PATH, P.PATTERN)
    assert tuples(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_empty(spark):
    assert round_trip(empty(spark), PATH, P.PATTERN).collect() == []
