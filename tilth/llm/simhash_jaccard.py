"""SimHash near-dedup up to a Jaccard similarity of word shingles.

At a similarity of 0.8 two SimHash fingerprints differ in about 15 of 100 bits, more than a Hamming
radius can serve alone. So every document has several 23-bit fingerprints, each over hashes of its
own, and each is bound to an anchor, the smallest hash of the document's shingles under one more
function: documents at 0.8 share an anchor four times in five, others next to never. A band's keys are
its anchor with each Golay index of its fingerprint (codewords at distance 4 or less: one or six), and
documents meet where a key is equal.

Those that meet are compared by sketches of 128 one-byte minimum hashes. Far above the threshold they
link, far below they don't, and what lies between is decided by the shingles themselves. Buckets work
in blocks of bounded size, and links leave them as stars. Pairs in doubt are settled in two steps.
First, neighbouring blocks of a bucket only: the best doubtful partner of each document, so a group
costs about as many exact comparisons as it has documents. Then, once components are known, every
document in doubt against another component asks that component's slice, a set of about a hundred of
its documents, not one by one; a slice answers all that ask it from the shingles themselves. So near
copies that differ a little too much leave one row for each slice, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm._shared import LOWERED, checkpoint, connected_components, join_counted, lean, small_batches, text_of
from tilth.llm.simhash import golay_indices, hashes

BANDS, SKETCH, BITS = 12, 128, 23
#: How far a sketch's estimate may stray: four standard deviations at 0.8, in equal bytes out of SKETCH.
STRAY = 18
_RNG = np.random.default_rng(19)
_ODD = _RNG.integers(0, 1 << 63, BANDS + SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS + SKETCH, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, -(-BANDS * BITS // 64), np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sketch(h: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Anchors and fingerprints of the bands, and the sketch, of distinct shingle hashes (one at least)."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    bits = np.zeros(64 * len(_MIX), np.int64)
    for i in range(0, len(h), step):
        part = h[i : i + step]
        least = np.minimum(least, np.array([(part * a + b).min() for a, b in zip(_ODD, _ADD, strict=True)]))
        mixed = np.stack([_scramble(part * m) for m in _MIX], 1)
        bits += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    voted = (2 * bits[: BANDS * BITS] > len(h)).reshape(BANDS, BITS)
    return least[:BANDS], voted @ (1 << np.arange(BITS)), (_scramble(least[BANDS:]) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n1, n2 (a hash of the words), anchors, prints, sketch; without words the last three are null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                words = b" ".join(text.encode("utf-8", "surrogatepass").translate(LOWERED).split())
                both = np.frombuffer(xxhash.xxh3_128_digest(words), np.int64)
                if words:
                    anchors, prints, own = sketch(np.unique(hashes(text, k)))
                    rows.append((*both, anchors.view(np.int64), prints, own))
                else:
                    rows.append((*both, None, None, None))
            yield pd.concat([b[["doc_id"]], pd.DataFrame(rows, columns=["n1", "n2", "anchors", "prints", "sketch"], index=b.index)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(lean(work), f"doc_id {kind}, n1 long, n2 long, anchors array<long>, prints array<long>, sketch binary")


def _keys(reps: DataFrame) -> DataFrame:
    """key, rep, component: the bands' keys of each document."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            anchors = np.stack(b["anchors"].to_numpy()).view(np.uint64)
            near = golay_indices(np.stack(b["prints"].to_numpy()).reshape(-1)).reshape(*anchors.shape, -1)
            band = np.arange(BANDS, dtype=np.uint64)
            keys = _scramble((anchors + band * np.uint64(0x9E3779B97F4A7C15))[:, :, None] ^ (near.astype(np.uint64) << np.uint64(50))).view(np.int64)
            at = np.nonzero(near >= 0)
            yield pd.DataFrame({"key": keys[at], "rep": b["rep"].to_numpy()[at[0]], "component": b["component"].to_numpy()[at[0]]})

    return reps.select("rep", "component", "anchors", "prints").mapInPandas(lean(keyed), "key long, rep long, component long")


def _buckets(keys: DataFrame, reps: DataFrame, block: int, ring: bool) -> DataFrame:
    """Of every two blocks (with ring: of a block with itself and the next one) of every key that several documents have: their reps, components and sketches."""
    count = F.count("*").alias("members")
    if ring:  # every document is a component of its own yet
        sizes = keys.groupBy("key").agg(count).filter("members > 1")
    else:
        sizes = keys.groupBy("key").agg(count, (F.min("component") < F.max("component")).alias("joins")).filter("joins").drop("joins")
    blocks = F.col("blocks")
    partners = F.array_distinct(F.array(F.col("mine"), F.pmod(F.col("mine") + 1, blocks), F.pmod(F.col("mine") - 1, blocks))) if ring else F.sequence(F.lit(0), blocks - 1)
    return (
        join_counted(keys.select("key", "rep"), sizes.withColumn("n", F.col("members")), ["key"], keys.count())
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .join(reps.select("rep", "component", "size", "slice", "sketch"), "rep")
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(partners))
        .groupBy("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
        .agg(F.collect_list(F.struct("rep", "component", "mine", "sketch", "size", "slice")).alias("rows"))
        .filter(F.size("rows") > 1)
        .select("p", "q", *[F.col(f"rows.{c}").alias(c) for c in ("rep", "component", "mine", "sketch", "size", "slice")])
    )


def _limits(least: float) -> tuple[float, float]:
    """Equal bytes from which on a pair is sure, and in doubt."""
    share = least + (1 - least) / 256  # bytes of different hashes may be equal
    return min(SKETCH, SKETCH * share + STRAY), SKETCH * share - STRAY


def _candidates(b: pa.RecordBatch, doubt_at: float) -> Iterator[tuple]:
    """Of each row of blocks: its lists, and i, j and equal bytes of the pairs of different components that may be similar."""
    lists = [b.column(c) for c in ("rep", "component", "mine", "size", "slice")]
    for p, q, sketches_, *own in zip(b.column("p").to_numpy(), b.column("q").to_numpy(), b.column("sketch"), *lists, strict=True):  # Arrow, for a row's lists are read where they lie
        rep, component, mine, size, part = (v.values.to_numpy() for v in own)
        x = np.frombuffer(b"".join(sketches_.values.to_pylist()), np.uint8).reshape(-1, SKETCH)
        equal = np.array([(x == row).sum(axis=1) for row in x])
        can = component[:, None] != component[None, :]
        if p != q:
            side = mine == q
            can &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(can & (equal >= doubt_at), 1))
        if len(i):
            yield rep, component, size, part, i, j, equal[i, j]


def _compared(buckets: DataFrame, least: float) -> DataFrame:
    """(a, b, sure): links that sketches settle, as stars, and each document's best doubtful pair."""
    sure_at, doubt_at = _limits(least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}  # what this task has linked: a link within one of its components says nothing new
        said: set[tuple[int, int]] = set()

        def find(i: int) -> int:
            while (up := joined.get(i, i)) != i:
                joined[i] = i = joined.get(up, up)
            return i

        for b in batches:
            found = []
            for rep, _, _, _, i, j, n in _candidates(b, doubt_at):
                root = np.arange(len(rep))
                a, c = i[n >= sure_at], j[n >= sure_at]
                while len(a):
                    before = root.copy()
                    low = np.minimum(root[a], root[c])
                    np.minimum.at(root, a, low)
                    np.minimum.at(root, c, low)
                    root = root[root]
                    if (root == before).all():
                        break
                at = np.nonzero(root != np.arange(len(rep)))[0]
                for x1, x2 in zip(rep[at].tolist(), rep[root[at]].tolist(), strict=True):
                    if (r1 := find(x1)) != (r2 := find(x2)):
                        joined[max(r1, r2)] = min(r1, r2)
                        found.append((x1, x2, True))
                open_ = (n < sure_at) & (root[i] != root[j])
                i, j, n = i[open_], j[open_], n[open_]
                if len(i):
                    order = np.argsort(-n, kind="stable")
                    both = np.concatenate([i[order], j[order]])
                    place = np.concatenate([order, order])
                    rank = np.argsort(np.concatenate([-n[order], -n[order]]), kind="stable")
                    _, first = np.unique(both[rank], return_index=True)
                    pick = np.unique(place[rank][first])
                    i, j = i[pick], j[pick]
                for pair in zip(rep[i].tolist(), rep[j].tolist(), strict=True):
                    if pair not in said and find(pair[0]) != find(pair[1]):
                        said.add(pair)
                        found.append((*pair, False))
            cols = [np.array([f[k] for f in found], np.int64 if k < 2 else bool) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(cols[0], cols[1]), np.maximum(cols[0], cols[1]), cols[2])], ["a", "b", "sure"])

    return buckets.mapInArrow(lean(work), "a long, b long, sure boolean").distinct()


def _asked(buckets: DataFrame, least: float) -> DataFrame:
    """rep, component, slice: which slices of other components a document may be similar to. Of two components the smaller one's documents ask."""
    _, doubt_at = _limits(least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[int, int, int]] = set()
        for b in batches:
            fresh: set[tuple[int, int, int]] = set()
            for rep, component, size, part, i, j, _ in _candidates(b, doubt_at):
                turn = (size[i] > size[j]) | ((size[i] == size[j]) & (component[i] > component[j]))
                small, big = np.where(turn, j, i), np.where(turn, i, j)
                fresh.update(zip(rep[small].tolist(), component[big].tolist(), part[big].tolist(), strict=True))
            fresh -= said
            said |= fresh
            cols = list(zip(*fresh, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "component", "slice"])

    return buckets.mapInArrow(lean(work), "rep long, component long, slice long").distinct()


def _shingle_sets(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """rep and own, the sorted distinct shingle hashes, of the documents in wanted (rep)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text")).join(wanted, "rep", "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rep": b["rep"], "own": [np.unique(hashes(t, k)).tobytes() for t in b["text"]]})

    return texts.mapInPandas(lean(sets), "rep long, own binary")


def _answered(asked: DataFrame, members: DataFrame, docs: DataFrame, k: int, least: float, together: int = 128) -> DataFrame:
    """Links (a, b) of documents that ask to one of the slice's that is as similar as least, for each slice that has one. members: rep, component, slice."""
    here = ["component", "slice"]
    held = members.join(asked.select(*here).distinct(), here, "left_semi")
    own = checkpoint(_shingle_sets(asked.select("rep").unionByName(held.select("rep")).distinct(), docs, k))
    slices = held.join(own, "rep").groupBy(*here).agg(F.collect_list(F.struct("rep", "own")).alias("held"))
    counts = asked.groupBy(*here).agg(F.count("*").alias("n")).withColumn("many", F.col("n"))
    parted = join_counted(asked, counts, here, asked.count()).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("many") / together)))
    asking = parted.join(own, "rep").groupBy(*here, "part").agg(F.collect_list(F.struct("rep", "own")).alias("asking"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for held, asking in zip(b["held"], b["asking"], strict=True):
                names = [h["rep"] for h in held]
                parts = [np.frombuffer(h["own"], np.uint64) for h in held]
                sizes = np.array([len(p) for p in parts])
                all_, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
                for a in asking:
                    mine = np.frombuffer(a["own"], np.uint64)
                    at = np.minimum(np.searchsorted(mine, all_), len(mine) - 1)
                    both = np.bincount(of[mine[at] == all_], minlength=len(parts))
                    near = np.nonzero(both >= least * (len(mine) + sizes - both) - 1e-9)[0]
                    if len(near):
                        found.append((a["rep"], names[near[0]]))
            yield pd.DataFrame(found, columns=["a", "b"])

    return asking.join(slices, here).select("held", "asking").mapInPandas(lean(work), "a long, b long")


def _exact(pairs: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose shingle sets are as similar as least."""
    own = _shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs, k)
    joined = pairs.join(own.select(F.col("rep").alias("a"), F.col("own").alias("own_a")), "a").join(own.select(F.col("rep").alias("b"), F.col("own").alias("own_b")), "b")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["own_a"], b["own_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    return joined.mapInPandas(lean(work), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, block: int = 128) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links, for each doc_id that isn't null.

    Documents link if their words are the same or their sets of k-word shingles (fewer words: all as
    one) have a Jaccard similarity of `least` or more; A-Z count as a-z. Defined cases: texts without
    words (null, empty) are copies of each other; rows that share a doc_id are one document, named by
    all its texts; null doc_ids aren't returned; an empty table gives an empty one; other columns are
    not looked at. Pairs at the threshold share a bucket with a probability over 0.99.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    every = checkpoint(sketches(known, k).withColumn("rep", F.col("doc_id").cast("long")))
    classes = checkpoint(every.groupBy("n1", "n2").agg(F.min("rep").alias("least"), F.count("*").alias("n")))
    first = every.filter("sketch is not null").join(classes.select("n1", "n2", F.col("least").alias("rep")), ["n1", "n2", "rep"], "left_semi").select("rep", "anchors", "prints", "sketch").dropDuplicates(["rep"])
    reps = checkpoint(first.withColumns({"component": F.col("rep"), "size": F.lit(1).cast("long"), "slice": F.lit(0).cast("long")}))
    same = every.join(classes.filter("n > 1").select("n1", "n2", "least"), ["n1", "n2"]).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    with small_batches(docs.sparkSession):
        found = checkpoint(_compared(_buckets(_keys(reps), reps, block, ring=True), least))
        links = checkpoint(found.filter("sure").select("a", "b").unionByName(_exact(found.filter("not sure").select("a", "b"), known, k, least)))
        parts = connected_components(links)
        sizes = parts.groupBy("component").agg(F.count("*").alias("size")).withColumn("n", F.col("size"))
        parts = join_counted(parts, sizes, ["component"], parts.count())
        now = reps.drop("component", "size", "slice").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        now = now.withColumns({"component": F.coalesce("component", "rep"), "size": F.coalesce("size", F.lit(1))})
        now = checkpoint(now.withColumn("slice", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / block))))
        asked = checkpoint(_asked(_buckets(_keys(now), now, block, ring=False), least))
        with small_batches(docs.sparkSession, 4):  # a row holds the shingles of two hundred documents
            more = checkpoint(_answered(asked, now.select("rep", "component", "slice"), known, k, least))
    parts = connected_components(links.unionByName(more).unionByName(same))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = every.select("rep").distinct().join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return ids.select(F.col("rep").cast(kind).alias("doc_id"), F.coalesce("component", "rep").cast(kind).alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs but for those in a group whose smallest doc_id is another. Rows without a doc_id stay."""
    gone = near_duplicates(docs, k, least).filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
