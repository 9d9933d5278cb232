"""Embedding near-dedup by cross-polytope hashing.

Each of a few tables turns a vector by three rounds of random signs and the fast Hadamard transform,
once for each part of its key, and takes the nearest signed axes. Both sides probe: every part has its
two nearest axes, and a vector goes to all buckets that one choice for each part names. Vectors that
share a bucket are compared in double precision. A key has as many parts as keep chance meetings few
at this number of vectors, and as many tables as keep the recall.

Equal vectors are one class from the start. A bucket works on blocks: its members are dealt into parts
of bounded size, and every two parts meet in one task row, which counts links and keeps a star of each
local component. No pair is ever written. A pair that shares several buckets counts in the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm._shared import checkpoint, connected_components, join_counted, small_batches

#: Bytes of vectors in a block: the most that half of a task row holds.
BLOCK_BYTES = 256 << 10


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their size: the largest component is made one first, so no square over- or underflows."""
    x = np.asarray(x, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_axes(x: np.ndarray, tables: int, parts: int, probes: int, seed: int = 5) -> np.ndarray:
    """(rows, tables, parts, probes) signed axes, the nearest first."""
    rows, d = x.shape
    wide = 1 << max(0, d - 1).bit_length()
    x = np.pad(unit(x), ((0, 0), (0, wide - d)))
    rng = np.random.default_rng((seed, wide))
    probes = min(probes, wide)
    out = np.empty((rows, tables, parts, probes), np.int32)
    for table in range(tables):
        for part in range(parts):
            turned = x
            for _ in range(3):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], wide))
            top = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :probes]
            out[:, table, part] = 2 * top + (np.take_along_axis(turned, top, 1) > 0)
    return out


def bucket_codes(axes: np.ndarray, wide: int) -> np.ndarray:
    """(rows, tables * probes ** parts) bucket numbers; those of one table stand together and begin with its number. Ordered as the axes are, part by part."""
    rows, tables, parts, probes = axes.shape
    out = []
    for table in range(tables):
        for choice in product(range(probes), repeat=parts):
            code = np.full(rows, table, np.int64)
            for part, k in enumerate(choice):
                code = code * (2 * wide) + axes[:, table, part, k]
            out.append(code)
    return np.stack(out, 1)


def shape(vectors: int, wide: int, probes: int = 2, crowd: int = 64, tables: int | None = None, parts: int | None = None) -> tuple[int, int]:
    """Tables and parts for so many distinct vectors: parts, three at least, so that no more than `crowd` unrelated ones meet in a bucket, as many as a code of 62 bits holds.

    A part's axes agree with a probability of about 0.94 at cosine 0.98 (measured, 32 to 1536
    dimensions), and tables make up for what more parts lose: 0.995 of such pairs share a bucket.
    """
    bits = max(1, (2 * wide - 1).bit_length())
    if parts is None:
        parts = 3
        while vectors * (probes / (2 * wide)) ** parts > crowd and (parts + 1) * bits <= 58:
            parts += 1
    return tables or math.ceil(math.log(0.005) / math.log(1 - 0.94**parts)), parts


def _links(vec, weight, axes, table, code, side, least):
    """Of one block in one bucket: links of each member counted in copies, and each member's smallest local neighbour of neighbours.

    axes: (members, tables, parts, probes). A pair counts here if this is its first bucket: they share
    none in an earlier table, and this one's axes are the smallest that both have, part by part.
    """
    x = unit(vec)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near))
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        a, b = axes[i, t], axes[j, t]  # pairs, parts, probes
        both = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
        if t < table:
            first &= ~both.any(axis=2).all(axis=1)
        else:
            first &= (np.where(both, a, np.iinfo(np.int32).max).min(axis=2) == code).all(axis=1)
    i, j = i[first], j[first]
    count = np.bincount(i, weight[j], len(vec)) + np.bincount(j, weight[i], len(vec))
    root = np.arange(len(vec))
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return count.astype(np.int64), root


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int | None = None, parts: int | None = None, probes: int = 2, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    Defined cases: a null label, and a vector that is null, empty or zero or holds a null, NaN or
    infinity, links with nothing: its component is itself and it is kept. Vectors of different length
    don't link. Rows that share a vec_id are nodes with one name. A null vec_id is kept as it is. An
    empty table gives an empty one; other columns are not looked at. Tables and parts follow from the
    number of distinct vectors, a block's members from BLOCK_BYTES, unless they are given.
    """
    spark = vectors.sparkSession
    d = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    kind_of = np.float32 if d == "array<float>" else np.float64
    own = vectors.select("vec_id", F.col("embedding").cast(d).alias("embedding"), "label")
    whole = F.size("embedding") > 0
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    own = own.withColumn("links", F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & whole & finite, F.lit(False)))
    label = vectors.schema["label"].dataType.simpleString()
    classes = checkpoint(own.filter("links").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("rep", F.col("rep").cast("long")))
    sizes = {r["dims"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    plans = {dims: shape(n, 1 << max(0, dims - 1).bit_length(), probes, tables=tables, parts=parts) for dims, n in sizes.items()}

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, same in b.groupby(b["embedding"].map(len)):
                x = np.stack(same["embedding"].to_numpy())
                axes = nearest_axes(x, *plans[dims], probes)
                codes = bucket_codes(axes, 1 << max(0, dims - 1).bit_length())
                yield pd.DataFrame({"label": same["label"], "dims": dims, "rep": same["rep"], "n": same["n"], "vec": [v.astype(kind_of).tobytes() for v in x], "axes": [a.tobytes() for a in axes], "codes": list(codes)}, index=same.index)

    rows = checkpoint(classes.mapInPandas(hashed, f"label {label}, dims int, rep long, n long, vec binary, axes binary, codes array<long>"))
    bucket = ["label", "dims", "code"]
    members = rows.select("label", "dims", "rep", F.explode("codes").alias("code"))
    crowds = members.groupBy(*bucket).agg(F.count("*").alias("members")).filter("members > 1")
    per_block = F.lit(block) if block else F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (F.col("dims") * kind_of().itemsize)))
    dealt = (
        rows.withColumn("code", F.explode("codes"))
        .drop("codes")
        .join(crowds, bucket)
        .withColumn("blocks", F.ceil(F.col("members") / per_block).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .groupBy(*bucket, F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
        .agg(F.collect_list(F.struct("rep", "n", "mine", "vec", "axes")).alias("rows"))
        .filter(F.size("rows") > 1)
        .select("code", "dims", "p", "q", F.col("rows.rep").alias("rep"), F.col("rows.n").alias("n"), F.col("rows.mine").alias("mine"), F.col("rows.vec").alias("vec"), F.col("rows.axes").alias("axes"))
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # Arrow, for a row's lists are read where they lie
            code, dims, p, q = (b.column(c).to_numpy() for c in ("code", "dims", "p", "q"))
            rep, n, mine, vec, axes = (b.column(c) for c in ("rep", "n", "mine", "vec", "axes"))
            out = []
            for i in range(b.num_rows):
                ids = rep[i].values.to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, part = ids[order], mine[i].values.to_numpy()[order]
                side = part == q[i] if p[i] != q[i] else np.zeros(len(ids), bool)
                x = np.frombuffer(b"".join(vec[i].values.to_pylist()), kind_of).reshape(len(ids), -1)[order]
                tables_, parts_ = plans[dims[i]]
                keys = np.frombuffer(b"".join(axes[i].values.to_pylist()), np.int32).reshape(len(ids), tables_, parts_, -1)[order]
                wide, rest, own_code = 2 << max(0, int(dims[i]) - 1).bit_length(), int(code[i]), []
                for _ in range(parts_):
                    rest, axis = divmod(rest, wide)
                    own_code.append(axis)
                count, root = _links(x, n[i].values.to_numpy()[order], keys, rest, np.array(own_code[::-1]), side, least)
                if (at := np.nonzero(count)[0]).size:
                    out.append((ids[at], count[at], ids[root[at]]))
            columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "n", "root"])

    with small_batches(spark, 32):
        found = checkpoint(dealt.mapInArrow(compared, "rep long, n long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("others"))
    parts_of = connected_components(found.select("rep", "root").distinct(), "rep", "root").select(F.col("node").alias("rep"), "component")
    named = classes.join(counts, "rep", "left").join(parts_of, "rep", "left").select("label", "embedding", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    can = own.filter("links").select("vec_id", "label", "embedding")
    linked = join_counted(can, named, ["label", "embedding"], can.count()).select("vec_id", "n_links", F.col("component_id").cast(kind).alias("component_id"))
    alone = own.filter("not links").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
