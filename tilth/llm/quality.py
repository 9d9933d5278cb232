"""Quality rules and an isolation forest on their statistics.

The rules' statistics are counts of one text. The forest's cuts fall at random in the box of all
labelled documents, so they need no rows; half of the good ones, all of that half, are counted in them,
each tree parts them until they stand alone, and what is unlike them ends on a short path. The threshold
on path lengths is then calibrated on all other labelled documents, on which no tree was grown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm._shared import checkpoint, lean, text_of, worker_table

BLANK_BYTES = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = tuple(bytes([c]) for c in range(65, 91))
#: Marks whose share tells shouting and lists from prose.
MARKS = "!?;:=_~^{}[]()/\\@"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share", "short_share")


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and RATES of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    blanks = sum(map(data.count, (BLANK_BYTES[i : i + 1] for i in range(6))))
    chars = len(text) - blanks
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        count: dict[tuple, int] = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        end = 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    upper, marks = sum(map(data.count, CAPITALS)), sum(map(text.count, MARKS))
    one = max(1, n)
    rates = (np.log1p(n), chars / one, symbols / one, dup / max(1, len(lines)), repeated / one, upper / max(1, chars), marks / one, len(set(words)) / one, sum(len(w) < 2 for w in words) / one)
    return (n, chars, symbols, dup, repeated), rates


def base_failed(n_words, n_repeat_words):
    """The plain rules: fewer than 50 words, or over half of them in repeated windows."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass(frozen=True)
class Forest:
    """Flat trees: axis, cut and children by node (axis -1: a leaf, with its path length in cut)."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    threshold: float = -np.inf

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """The mean path length of each row over the trees."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while len(at := np.nonzero(self.axis[node] >= 0)[0]):
                here = node[at]
                node[at] = np.where(x[rows[at], self.axis[here]] < self.cut[here], self.left[here], self.right[here])
            total += self.cut[node]
        return total / len(self.roots)


def _expected(n: np.ndarray) -> np.ndarray:
    """The mean depth at which random binary trees over n rows isolate one."""
    many = np.maximum(n, 3).astype(float)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + 0.5772156649) - 2 * (many - 1) / many))


@dataclass(frozen=True)
class Cuts:
    """Random cuts of a box, whatever rows it holds: tree by tree, nodes numbered as in a heap from 1, leaves 2^depth and on."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    trees: int = 120
    depth: int = 14
    seed: int = 7

    def of(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Axis and cut by node. Cuts fall anywhere in a node's part of the box, which begins whole, so empty room is cut off early."""
        rng = np.random.default_rng((self.seed, tree))
        axis, cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        lo, hi = np.array([self.low]), np.array([self.high])
        wide = np.nonzero(hi[0] > lo[0])[0]
        for level in range(self.depth):
            n = 1 << level
            own = np.arange(n)
            k = axis[n : 2 * n] = rng.choice(wide, n)
            at = cut[n : 2 * n] = rng.uniform(lo[own, k], hi[own, k])
            lo, hi = np.repeat(lo, 2, axis=0), np.repeat(hi, 2, axis=0)
            hi[2 * own, k] = lo[2 * own + 1, k] = at
        return axis, cut

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each row."""
        axis, cut = all_cuts(self)[tree]
        node, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[rows, axis[node]] >= cut[node])
        return node


@worker_table
def all_cuts(cuts: Cuts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For a worker's tasks, all trees' axes and cuts (18 MB at 120 trees of depth 14)."""
    return [(axis.astype(np.int8), cut) for axis, cut in map(cuts.of, range(cuts.trees))]


def forest_of(cuts: Cuts, tree: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> Forest:
    """The trees as far as they part rows. tree, leaf, n: how many rows each leaf holds, where it holds any."""
    parts, size = [], 0
    for t in range(cuts.trees):
        count = np.zeros(2 << cuts.depth, np.int64)
        own = tree == t
        count[leaf[own]] = n[own]
        for level in range(cuts.depth - 1, -1, -1):
            a = 1 << level
            count[a : 2 * a] = count[2 * a : 4 * a : 2] + count[2 * a + 1 : 4 * a : 2]
        open_ = count > 1
        open_[1 << cuts.depth :] = False
        inner = np.nonzero(open_)[0]
        node = np.sort(np.concatenate([[1], 2 * inner, 2 * inner + 1]))
        place = np.zeros(2 << cuts.depth, np.int64)
        place[node] = size + np.arange(len(node))
        axis, cut = cuts.of(t)
        is_open, up = open_[node], np.minimum(node, (1 << cuts.depth) - 1)
        value = np.where(is_open, cut[up], np.floor(np.log2(node)) + _expected(count[node]))
        below = np.where(is_open, node, 0)
        parts.append((np.where(is_open, axis[up], -1), value, place[2 * below], place[2 * below + is_open]))
        size += len(node)
    axis, cut, left, right = map(np.concatenate, zip(*parts, strict=True))
    return Forest(axis, cut, left, right, np.nonzero(np.concatenate([np.arange(len(p[0])) == 0 for p in parts]))[0])


def grow(rows: DataFrame, low: np.ndarray, high: np.ndarray) -> Forest:
    """Trees over all rows (RATES) in the box (low, high). The driver gets one count for each leaf that holds rows, trees times 2^depth at most."""
    cuts = Cuts(tuple(low.tolist()), tuple(high.tolist()))
    if not (high > low).any():
        one = np.zeros(1, int)
        return Forest(one - 1, _expected(np.array([rows.count()])), one, one, one)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((cuts.trees, 1 << cuts.depth), np.int64)
        for b in batches:
            x = b.to_numpy(float)
            for t in range(cuts.trees):
                counts[t] += np.bincount(cuts.leaves(x, t) - (1 << cuts.depth), minlength=1 << cuts.depth)
        tree, leaf = np.nonzero(counts)
        yield pd.DataFrame({"tree": tree, "leaf": leaf + (1 << cuts.depth), "n": counts[tree, leaf]})

    counted = rows.select(*RATES).mapInPandas(lean(work, "all_cuts"), "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toPandas()
    return forest_of(cuts, *(counted[c].to_numpy() for c in ("tree", "leaf", "n")))


def _nth(values: DataFrame, k: int, few: int = 10_000, bins: int = 4096) -> float:
    """The k-th smallest (from 0) of the column x, exactly: counted in bins of what is left of the range until few are left."""
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    while n > few and low < high:
        at = F.least(F.floor((F.col("x") - low) * (bins / (high - low))), F.lit(bins - 1))
        for _, n, low, high in sorted(values.groupBy(at.alias("bin")).agg(F.count("*"), F.min("x"), F.max("x")).collect()):
            if k < n:
                break
            k -= n
        values = values.filter(F.col("x").between(low, high))
    return low if low == high else sorted(r[0] for r in values.collect())[k]


def train(rows: DataFrame, most_lost: float = 0.001) -> Forest:
    """Grown on half of the good rows, by a hash of doc_id; the threshold keeps all but most_lost of the other half and is lifted no further than the bad rows ask for.

    rows: doc_id, good, RATES. All of them count, in the trees or in the threshold. Without labelled rows
    the forest has no trees' threshold to reject by: it keeps everything.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    box = [f(c) for f in (F.min, F.max) for c in RATES]
    n, good, grown, *ends = rows.agg(F.count("*"), F.count_if("good"), F.count_if(F.col("good") & half), *box).first()
    if not good:
        empty = np.zeros(1, int)
        return Forest(empty - 1, np.zeros(1), empty, empty, empty)
    low, high = np.array(ends, float).reshape(2, -1)
    forest = grow(rows.filter(F.col("good") & half) if grown else rows.filter("good"), low, high)
    if not grown or grown == good or good == n:
        return forest

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"good": b["good"], "x": forest.path_lengths(b[list(RATES)].to_numpy(float))})

    paths = checkpoint(rows.filter(~(F.col("good") & half)).select("good", *RATES).mapInPandas(lean(work), "good boolean, x double"))
    held = paths.filter("good").select("x")
    at = most_lost * (good - grown - 1)
    below, above = _nth(held, int(at)), _nth(held, min(int(at) + 1, good - grown - 1))
    limit = below + (above - below) * (at - int(at))
    worst = paths.filter(~F.col("good") & (F.col("x") < limit)).agg(F.max("x")).first()[0]
    if worst is None:
        return forest
    least = held.filter(F.col("x") > worst).agg(F.min("x")).first()[0]
    return replace(forest, threshold=(worst + min(limit, least)) / 2)


STATS_SCHEMA = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RATES)])


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, COUNTS, RATES, and the columns in keep."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*c, *r) for c, r in map(statistics, b["text_"])]
            yield pd.concat([b.drop(columns="text_"), pd.DataFrame(rows, columns=[*COUNTS, *RATES], index=b.index)], axis=1)

    own = docs.select("doc_id", *keep, text_of().alias("text_"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInPandas(lean(work), f"{head}, {STATS_SCHEMA}")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int | None = None) -> Forest:
    """A forest from all labelled documents; with most_rows from so many at most, those with the smallest hashes of doc_id.

    Labels with a null, and documents with two different labels, aren't used. Of rows that share a
    labelled doc_id the one with the smallest statistics counts.
    """
    one = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    if most_rows is not None:
        one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    one_each = with_statistics(docs).groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *RATES)).alias("least"))
    got = one_each.join(one.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id").select("doc_id", "good", "least.*")
    return train(checkpoint(got.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", "good", *RATES)))


def judge(docs: DataFrame, labels: DataFrame, most_rows: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, path_length, and the columns in keep, for each row of docs.

    kept is false where the plain rules fail, else the forest's verdict. Defined cases: a null or
    empty text has no words and fails; repeated rows are judged each; a null doc_id is carried; an
    empty table gives an empty one; without labels only the plain rules reject; other columns are
    not looked at.
    """
    forest = fit(docs, labels, most_rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*c, *r) for c, r in map(statistics, b["text_"])]
            s = pd.DataFrame(rows, columns=[*COUNTS, *RATES], index=b.index)
            s["base_failed"] = base_failed(s["n_words"], s["n_repeat_words"])
            s["path_length"] = forest.path_lengths(s[list(RATES)].to_numpy(float))
            s["kept"] = ~s["base_failed"] & (s["path_length"] >= forest.threshold)
            yield pd.concat([b.drop(columns="text_"), s[[*COUNTS, "base_failed", "kept", "path_length"]]], axis=1)

    own = docs.select("doc_id", *keep, text_of().alias("text_"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return own.mapInPandas(lean(work), f"{head}, {counts}, base_failed boolean, kept boolean, path_length double")
