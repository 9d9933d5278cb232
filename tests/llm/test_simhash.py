import numpy as np
import xxhash

from tests.llm.helpers import docs, empty, rows, tuples
from tilth.llm.simhash import fingerprint_links, golay_indices, keys_of, simhash_components
from tilth.llm._shared import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def components(fps, near):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if root[j] < root[i] and near(fps[i], fps[j]):
                    root[i], changed = root[j], True
    return root


def test_golay_words_at_distance_two_share_an_index():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 4000)
    for b in (a, a ^ (1 << rng.integers(0, 23, 4000)), a ^ (1 << rng.integers(0, 23, 4000)) ^ (1 << rng.integers(0, 23, 4000))):
        x, y = golay_indices(a), golay_indices(b)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(x, y, strict=True))


def test_fingerprints_at_two_bits_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000, np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64))
    assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(keys_of(a), keys_of(b), strict=True))


def test_query_against_brute_force(spark):
    pairs = [*rows(), *((9100 + i, f"{'same long text ' * 9} {'tail ' * (i % 3)}") for i in range(30))]
    pairs = [(i, t) for i, t in pairs if len(t or "") < 60_000]
    fps = [plain_fingerprint(t) for _, t in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is None, pairs[k][0] or 0))
    named = components([fps[k] for k in order], lambda a, b: (a ^ b).bit_count() <= 2)
    want = sorted(((pairs[k][0], f"{fps[k]:016x}", pairs[order[c]][0]) for k, c in zip(order, named, strict=True)), key=repr)
    assert tuples(simhash_components(docs(spark, pairs)), "doc_id", "fingerprint", "component_id") == want


def test_full_buckets_take_the_exact_way(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 5)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 62, (80, 3))})
    named = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for small in (2, 32, 10_000):
        links = fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), small)
        assert all((a ^ b).bit_count() <= 2 for a, b in tuples(links, "a", "b"))
        got = dict(tuples(connected_components(links), "node", "component"))
        assert [got.get(f, f) for f in fps] == [fps[c] for c in named]


def test_empty(spark):
    assert simhash_components(empty(spark)).collect() == []
