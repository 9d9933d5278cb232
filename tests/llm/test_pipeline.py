import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.helpers import SF, docs, empty, rows
from tests.llm.test_line_dedup import brute as lines_left
from tests.llm.test_packing import docs_ids
from tests.llm.test_pii import scanned
from tests.llm.test_quality import labels, plain
from tilth.llm import queries
from tilth.llm._shared import lean
from tilth.llm.encoding import encoder
from tilth.llm.quality import judge
from tilth.llm.simhash_jaccard import near_duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    pairs = [(i, t) for i, t in rows(60) if i is not None and i not in (9011, 9012) and len(t or "") < 60_000]
    for g in range(12):
        base = r.choices(vocabulary, k=r.randint(6, 300))
        for k in range(r.randint(2, 25)):
            edited = list(base)
            for _ in range(k * len(base) // 300):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            pairs.append((1000 + len(pairs), " ".join(edited)))
    sets = [shingles(t) for _, t in pairs]
    name = [i for i, _ in pairs]
    near = [[j for j in range(len(pairs)) if j != i and similarity(sets[i], sets[j]) >= 0.8] for i in range(len(pairs))]
    for _ in range(20):
        for i, js in enumerate(near):
            name[i] = min([name[i], *(name[j] for j in js)])
    for block in (4, 256):
        got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs(spark, pairs), block=block).collect()}
        assert got == {i: n for (i, _), n in zip(pairs, name, strict=True)}


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    frame = docs(spark).select(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        before, n = frame.columns, frame.count()
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert frame.columns == before and 0 < frame.count() <= n
    assert frame.count()


def test_one_large_group_about_the_threshold(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    pairs = []
    for i in range(160):
        edited = list(base)
        for _ in range(r.randint(1, 5)):
            edited[r.randrange(120)] = f"x{r.randrange(10**9)}"
        pairs.append((i, " ".join(edited)))
    sets, name = [shingles(t) for _, t in pairs], list(range(160))
    near = [[j for j in range(160) if j != i and similarity(sets[i], sets[j]) >= 0.8] for i in range(160)]
    for _ in range(10):
        for i, js in enumerate(near):
            name[i] = min([name[i], *(name[j] for j in js)])
    assert len(set(name)) > 10 and max(Counter(name).values()) > 50
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs(spark, pairs), block=16).collect()}
    assert got == dict(enumerate(name))


def as_rows(frame):
    return Counter(tuple(r) for r in frame.select(corpus_pipeline.COLUMNS).collect())


def test_quality_stage_keeps_rows_as_they_are(spark):
    frame = docs(spark).select(corpus_pipeline.COLUMNS)
    got, all_ = as_rows(corpus_pipeline.keep_good(spark, frame, SF)), as_rows(frame)
    failed = {r for r in all_ if plain(r[1])[5]}
    assert not got - all_ and not failed & set(got)
    gone = Counter(r["doc_id"] for r in judge(frame, labels(spark)).filter("not kept").collect())
    assert Counter(r[0] for r in (all_ - got).elements()) == gone
    good = {r["doc_id"] for r in labels(spark).filter("quality = 1").collect()}
    asked = [r for r in all_ if r[0] in good and r not in failed]
    assert sum(r in got for r in asked) >= 0.99 * len(asked) > 0


def test_line_stage_keeps_the_last_holder(spark):
    import hashlib

    pairs = rows()
    got = corpus_pipeline.drop_repeated_lines(spark, docs(spark, pairs).select(corpus_pipeline.COLUMNS), SF).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r["doc_id"], sha(r["text"])) for r in got) == Counter((i, k) for i, _, _, k in lines_left(pairs))
    assert all(r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == ("en", "s") for r in got)


def test_pii_stage_hides_spans_and_nothing_else(spark):
    pairs = [(1, "write to a.b@c.de or 10.0.0.1 now"), (2, "nothing here"), (3, None), (None, "card 4111 1111 1111 1111."), (4, ""), (4, "")]
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.hide_personal_data(spark, docs(spark, pairs).select(corpus_pipeline.COLUMNS), SF).collect())
    want = [(1, "write to <EMAIL> or <IP> now"), (2, "nothing here"), (3, None), (None, "card <CARD>."), (4, ""), (4, "")]
    assert got == Counter((i, t, None if t is None else len(t)) for i, t in want)
    for r in corpus_pipeline.hide_personal_data(spark, docs(spark).select(corpus_pipeline.COLUMNS), SF).collect():
        assert len(r["text"] or "") > 20_000 or not scanned(r["text"] or "")


def test_packing_stage_holds_every_token_once(spark):
    pairs = rows(40)
    got = corpus_pipeline.pack(spark, docs(spark, pairs).select(corpus_pipeline.COLUMNS), SF).collect()
    want = Counter()
    for i, ids in docs_ids(pairs):
        n = -(-len(ids) // 2048)
        cuts = [0, *(len(ids) - k * 2048 for k in range(n - 1, -1, -1))]
        want.update((i, a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:], strict=False))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in got) == want


def test_empty(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark).select(corpus_pipeline.COLUMNS), SF).collect() == [], name


def test_workers_keep_no_tables_of_other_stages(spark, monkeypatch):
    kind, lean_ones = type(spark.range(1)), []
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(kind, name, lambda self, f, *a, real=getattr(kind, name), **b: lean_ones.append(hasattr(f, "__wrapped__")) or real(self, f, *a, **b))
    frame = docs(spark, rows(20)).select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SF)
    assert len(lean_ones) > 8 and all(lean_ones)
    made = encoder(queries.vocabulary(queries.BYTES), "bytes")
    assert list(lean(iter, "encoder")([1, 2])) == [1, 2] and encoder(queries.vocabulary(queries.BYTES), "bytes") is made
    assert list(lean(iter)([3])) == [3] and not encoder.cache_info().currsize
