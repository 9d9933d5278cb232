import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import docs, empty, rows
from tests.llm.test_token_files import library
from tilth.llm.packing import _Loose, apart, local_search, pack_documents, solve


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_every_piece_has_a_place(counts):
    bins = local_search(apart(counts), 60)
    held = Counter()
    for pattern, n in bins.items():
        assert 0 < sum(pattern) <= 60
        held.update({k: v * n for k, v in Counter(pattern).items()})
    assert held == Counter(counts)
    plan, seen = solve(counts, 60), defaultdict(list)
    for length, n in counts.items():
        for s, o in zip(*plan.place(np.full(n, length), np.arange(n)), strict=True):
            seen[s].append((o, length))
    assert plan.sequences == len(seen) == sum(bins.values())
    for parts in seen.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length


def best_fit(counts, capacity):
    """The yardstick: best fit decreasing, piece by piece."""
    rooms = []
    for x in sorted(Counter(counts).elements(), reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - x)
    return len(rooms)


def test_search_empties_bins():
    first = Counter({(7, 4): 3, (6, 5): 3, (3, 3): 1, (2,): 1})
    assert sum(local_search(first, 14).values()) < sum(first.values())
    counts = {6: 3, 7: 1, 5: 1, 8: 2, 3: 2, 4: 1}
    assert best_fit(counts, 14) == 5 and sum(local_search(apart(counts), 14).values()) == 4


def test_one_for_two_and_two_for_two():
    assert _Loose(Counter({(9, 3): 1, (7, 4, 3): 1}), 16).best((7, 4, 3)) == ((9, 3), (4, 3, 3), (9, 7))
    a, new_a, new_b = _Loose(Counter({(8, 5): 1, (7, 4, 3): 1}), 16).best((7, 4, 3))
    assert (a, sum(new_b), sorted([*new_a, *new_b])) == ((8, 5), 16, [3, 4, 5, 7, 8])


def gains(bins, capacity):
    """Pairs of bins that an exchange of one or two pieces for none, one or two would improve."""
    sums = lambda p: {sum(x) for k in (1, 2) for x in combinations(p, k)}
    for a in bins:
        for b in bins:
            if sum(a) <= sum(b) < capacity and (a != b or bins[a] > 1) and any(0 < out - back <= capacity - sum(b) for out in sums(a) for back in {0, *sums(b)}):
                yield a, b


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_search_ends_where_nothing_helps(counts):
    bins = local_search(apart(counts), 60)
    least = -(-sum(k * v for k, v in counts.items()) // 60)
    assert sum(bins.values()) == least or not list(gains(bins, 60))
    assert sum(bins.values()) <= max(least, best_fit(counts, 60) + 1)


def test_search_has_no_budget():
    r = random.Random(1)
    counts = Counter(r.randint(500, 800) for _ in range(5000))  # best fit decreasing: 1723
    bins = local_search(apart(counts), 2048)
    assert sum(bins.values()) < 1660
    assert not list(gains(bins, 2048))
    first = Counter({(14, *(1,) * 41): 1, (66,): 2, (65,): 3})  # one bin holds 42 pieces
    assert sum(local_search(first, 80).values()) == 5


def docs_ids(pairs):
    """The library's ids of each text, with the end id."""
    plain = library("byte_bpe_50k.json")
    return [(i, [*plain(t or ""), 0]) for i, t in pairs]


def test_query(spark):
    pairs, plain = rows(), library("byte_bpe_50k.json")
    want = Counter()
    total = 0
    for i, t in pairs:
        ids = np.array([*plain(t or ""), 0], "<u4")
        total += len(ids)
        n = -(-len(ids) // 2048)
        for k in range(n):
            a, b = max(0, len(ids) - (n - k) * 2048), len(ids) - (n - k - 1) * 2048
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = pack_documents(docs(spark, pairs), P.path("byte_bpe_50k.json"), rows_per_group=4).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-total // 2048) + 1


def test_empty(spark):
    assert pack_documents(empty(spark), P.path("byte_bpe_50k.json")).collect() == []
