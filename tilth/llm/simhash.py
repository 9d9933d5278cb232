"""SimHash near-dedup with Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints at two or
fewer differing bits agree in one segment and differ in at most two bits of the next one. A segment
is read as a word of the perfect binary Golay code (23, 12, 7); its keys are the indices of all
codewords at distance 4 or less: one or six of them. Words at distance 2 or less always share such a
codeword: between them lies a word at distance 1 or less from both, which the perfect code decodes
within distance 3. A join key is an equal segment with one Golay index of the next segment.

Buckets of up to `small` fingerprints compare their members. Fuller ones are parted by the Golay
indices of the third segment, which two near fingerprints share as well. What is fuller even then takes
an exact way whose groups are bounded: every fingerprint goes to the 65 words at distance 1 or less;
two fingerprints link if and only if they meet at one, at most 65 meet there, and all of those link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm._shared import LOWERED, checkpoint, connected_components, join_counted, text_of

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """k-word shingles, repeats included; all words as one where there are fewer, none without words."""
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def hashes(text: str, k: int) -> np.ndarray:
    parts = shingles(text.encode("utf-8", "surrogatepass").translate(LOWERED).split(), k)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))


def majority(h: np.ndarray, step: int = 1 << 15) -> int:
    """Bit i is set if it is in over half of h; zero for no h."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), step):
        bits = np.unpackbits(h[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0]) if len(h) else 0


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error patterns that lead to codewords at distance 4 or less (-1: none). Syndromes of the low and high half."""

    def remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
        return v

    ones = 1 << np.arange(23)
    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    patterns = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        grid = np.array([sum(ones[list(c)]) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(low[grid & 4095] ^ high[grid >> 12], grid, strict=True):
            patterns[s, filled[s]] = e
            filled[s] += 1
    return patterns, low, high


def golay_indices(words: np.ndarray) -> np.ndarray:
    """The top 12 bits of the codewords near each 23-bit word: (n, 6), -1 where there are fewer."""
    patterns, low, high = _code()
    words = words.astype(np.int64)
    near = patterns[low[words & 4095] ^ high[words >> 12]]
    return np.where(near < 0, -1, (words[:, None] ^ near) >> 11)


def keys_of(fp: np.ndarray) -> np.ndarray:
    """(n, 18) join keys of unsigned fingerprints, -1 where there are fewer."""
    cut = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    out = []
    for i in range(3):
        near = golay_indices(cut[(i + 1) % 3])
        out.append(np.where(near < 0, -1, (i << 34) | (cut[i][:, None] << 12) | near))
    return np.concatenate(out, axis=1)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (long with the fingerprint's bits)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([majority(hashes(x, k)) for x in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(work, f"doc_id {kind}, fp long")


def fingerprint_links(distinct: DataFrame, small: int = 32) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links at two or fewer differing bits."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            k = keys_of(fp.view(np.uint64))
            at = np.nonzero(k >= 0)
            yield pd.DataFrame({"key": k[at], "fp": fp[at[0]]})

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key, fp = b["key"].to_numpy(np.int64), b["fp"].to_numpy(np.int64)
            near = np.full((len(fp), 6), -1, np.int64)
            for i, (at, n) in enumerate(SEGMENTS):
                own = (key >> 34) == (i + 1) % 3  # this segment is the third of such keys
                near[own] = golay_indices((fp[own].view(np.uint64) >> np.uint64(at)) & np.uint64((1 << n) - 1))
            row, col = np.nonzero(near >= 0)
            yield pd.DataFrame({"key": key[row], "third": near[row, col], "fp": fp[row]})

    def pairs_in(rows: DataFrame, by: list[str]) -> DataFrame:
        near = F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= 2)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
        return rows.groupBy(*by).agg(F.collect_list("fp").alias("fps")).select(F.explode(F.flatten(near)).alias("p")).select("p.a", "p.b")

    keyed = distinct.select("fp").mapInPandas(work, "key long, fp long")
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowd = size.filter(F.col("n") > small).select("key")
    finer = checkpoint(keyed.join(crowd, "key", "left_semi").mapInPandas(parted, "key long, third long, fp long"))
    size_3 = finer.groupBy("key", "third").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = pairs_in(keyed.join(size.filter(F.col("n") <= small), "key"), ["key"]).unionByName(pairs_in(finer.join(size_3.filter(F.col("n") <= small), ["key", "third"]), ["key", "third"])).distinct()
    fullest = finer.join(size_3.filter(F.col("n") > small), ["key", "third"], "left_semi").select("fp").distinct()
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = fullest.select("fp", F.explode(ball).alias("mid")).groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b")).distinct()
    return pairs.unionByName(stars)


def simhash_components(docs: DataFrame, k: int = 3, small: int = 32) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest doc_id reachable over links at two or fewer differing bits.

    Defined cases: a text that is null, empty or without words has fingerprint zero and links like
    any other; rows that share a doc_id are nodes with one name; a null doc_id is carried and gets
    the smallest doc_id of its component, or null; an empty table gives an empty one; other columns
    are not looked at. Copies stay with their fingerprint and are never expanded into pairs.
    """
    fps = checkpoint(fingerprints(docs, k))
    classes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(fingerprint_links(classes, small))
    named = classes.withColumnRenamed("n", "rows").join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_fp = join_counted(named, least, ["component"], classes.count()).select("fp", "component_id", F.col("rows").alias("n"))
    return join_counted(fps, by_fp, ["fp"], fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
