import numpy as np

from tests.llm.helpers import tuples
from tilth.llm.vectors import bucket_codes, hadamard, near_vectors, nearest_axes, shape

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, code int"


def brute(rows):
    ok = [e is not None and len(e) and l is not None and i is not None and all(v is not None and np.isfinite(v) for v in e) and any(e) for i, e, l in rows]
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if good else None for (_, e, _), good in zip(rows, ok, strict=True)]
    near = lambda a, b: ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98
    links = [[b for b in range(len(rows)) if b != a and near(a, b)] for a in range(len(rows))]
    name = [r[0] for r in rows]
    for _ in rows:
        for a in range(len(rows)):
            for b in links[a]:
                name[a] = min(name[a], name[b])
    return sorted(((r[0], len(l), c, r[0] == c) for r, l, c in zip(rows, links, name, strict=True)), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = rng.normal(size=32)
        for k in range(int(rng.integers(1, 30))):
            rows.append((len(rows) + 1, (base + rng.normal(size=32) * 0.05 * (k % 4)).astype("f4").tolist(), g % 3))
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 32, 1), (9004, [float("nan")] * 32, 1), (9005, [None] * 32, 1), (9006, rows[0][1], None), (9007, rows[0][1], 0), (9008, [float("inf")] * 32, 0), (9009, [1.0, 2.0, 3.0], 0), (9010, [2.0, 4.0, 6.0], 0), (9011, [5.0], 0), (9012, [7.0], 0), (9013, [-7.0], 0)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    for block in (8, 256):
        assert tuples(near_vectors(df, block=block), "vec_id", "n_links", "component_id", "kept") == brute(rows)


def test_copies_are_one_class(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0, "", 1) for i in range(50)] + [(i, [3.0, -2.0], 0, "", 1) for i in (60, 60)], SCHEMA)
    got = tuples(near_vectors(df), "vec_id", "n_links", "component_id")
    assert got == sorted([(i, 49, 0) for i in range(50)] + [(60, 1, 60)] * 2, key=repr)


def test_turns_keep_length_and_recall():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    for rows in (1000, 10**9, 10**13):
        tables, parts = shape(rows, 64)
        a, b = (bucket_codes(nearest_axes(v, tables, parts, 2), 64) for v in (x, y))
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(a, b, strict=True)]) > 0.985, (tables, parts)
        assert parts == 3 or rows / 64.0**parts <= 64


def test_any_size_and_number_of_parts(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(6):
        base = rng.normal(size=16)
        for k in range(5):
            size = [1e200, 1e-200, 1.0, 1e307, 3e-310][k]
            rows.append((len(rows) + 1, ((base + rng.normal(size=16) * 0.02) * size).tolist(), 0))
    schema = SCHEMA.replace("float", "double")
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    scaled = [(i, (np.array(e) / np.abs(e).max()).tolist(), l) for i, e, l in rows]
    for tables, parts in ((None, None), (6, 4), (4, 1)):
        assert tuples(near_vectors(df, tables=tables, parts=parts, block=8), "vec_id", "n_links", "component_id", "kept") == brute(scaled)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
