"""Best-fit packing by swap-based local search.

A packing depends on the pieces' lengths alone, and there are at most `capacity` lengths: the driver
sees one count for each length, never a piece. The search begins with every piece alone in its bin.
Bins that aren't full exchange up to two pieces for up to two, the fullest bin first: it takes what
fills it best from a bin that is no fuller, so every exchange raises the sum of squared fills, and
emptied bins go. It ends where no exchange is left, or at the volume bound. Equal bins change
together. The outcome is a list of patterns with a number of copies each; pieces take their places by
their rank within a length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.llm._shared import checkpoint, lean, text_of
from tilth.llm.encoding import encoder


def apart(counts: dict[int, int]) -> Counter:
    """Patterns (lengths, falling) with their copies: every piece in a bin of its own."""
    return Counter({(length,): n for length, n in counts.items()})


def _subsets(pattern: tuple) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """The pieces of the pattern, and pairs of them, by their sum."""
    kinds, two = Counter(pattern), {}
    for x, y in combinations(kinds, 2):
        two.setdefault(x + y, (x, y))
    for x, n in kinds.items():
        if n > 1:
            two.setdefault(2 * x, (x, x))
    return {x: (x,) for x in kinds}, two


class _Loose:
    """The bins with room, looked up by what they can give: one piece or two, of a certain sum."""

    def __init__(self, bins: Counter, capacity: int):
        self.bins, self.capacity = bins, capacity
        self.holders: list[list[dict[int, dict[tuple, None]]]] = [[{} for _ in range(capacity + 1)] for _ in range(2)]  # pieces less one, sum, room
        self.room = np.zeros((2, capacity + 1), np.int64)  # of the emptiest holder; 0 if there is none
        for p in bins:
            self._hold(p)

    def _hold(self, pattern: tuple) -> None:
        if room := self.capacity - sum(pattern):
            for k, sums in enumerate(_subsets(pattern)):
                for v in sums:
                    self.holders[k][v].setdefault(room, {})[pattern] = None
                    self.room[k, v] = max(room, self.room[k, v])

    def _drop(self, pattern: tuple) -> None:
        if room := self.capacity - sum(pattern):
            for k, sums in enumerate(_subsets(pattern)):
                for v in sums:
                    of = self.holders[k][v]
                    del of[room][pattern]
                    if not of[room]:
                        del of[room]
                        if room == self.room[k, v]:
                            self.room[k, v] = max(of, default=0)

    def add(self, pattern: tuple, n: int) -> None:
        """n more bins (fewer, below 0) of this pattern."""
        if not pattern:
            return
        had = self.bins[pattern]
        self.bins[pattern] = had + n
        if not had + n:
            del self.bins[pattern]
            self._drop(pattern)
        elif not had:
            self._hold(pattern)

    def best(self, b: tuple) -> tuple[tuple, tuple, tuple] | None:
        """A bin no fuller than b, and both after the exchange that fills b best, if one fills it at all.

        Among equals the exchange that leaves b the fewest pieces is taken, for small ones fit anywhere
        later, and among those the emptiest giver.
        """
        room, own, rooms = self.capacity - sum(b), _subsets(b), self.room
        alone = self.bins[b] == 1
        if alone:  # its own pieces are no offer
            rooms = rooms.copy()
            for k, sums in enumerate(own):
                for v in sums:
                    if rooms[k, v] == room and len(self.holders[k][v][room]) == 1:
                        rooms[k, v] = 0
        offered = np.maximum.accumulate(np.where(rooms >= room, np.arange(self.capacity + 1), 0), axis=1)  # the largest sum up to each
        found = None
        for back, sums in ((0, {0: ()}), (1, own[0]), (2, own[1])):
            give = np.fromiter(sums, np.int64, len(sums))
            for k in (0, 1) if sums else ():
                take = offered[k, give + room]
                more = take - give
                most = int(more.max())
                if most > 0:
                    at = np.nonzero(more == most)[0]
                    i = at[np.argmax(rooms[k, take[at]])]
                    key = most, back - k, int(rooms[k, take[i]])
                    if found is None or key > found[0]:
                        found = key, k, int(take[i]), sums[int(give[i])]
        if found is None:
            return None
        (_, _, free), k, total, gone = found
        a = next(p for p in self.holders[k][total][free] if not alone or p != b)
        come = _subsets(a)[k][total]
        new_a, new_b = Counter(a), Counter(b)
        new_a.subtract(come), new_b.subtract(gone)
        new_a.update(gone), new_b.update(come)
        return a, tuple(sorted(new_a.elements(), reverse=True)), tuple(sorted(new_b.elements(), reverse=True))


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchanges between underfull bins until a pass over all of them finds none that helps, or the volume bound is met.

    Equal bins change together: all copies that two patterns have between them. Every change raises the
    sum of squared fills, a whole number with a bound, so the search ends.
    """
    bins = Counter(bins)
    used, least = sum(bins.values()), -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    loose, changed = _Loose(bins, capacity), True
    while changed and used > least:
        changed = False
        queue = [(capacity - sum(p), p) for p in bins if sum(p) < capacity]
        heapq.heapify(queue)
        while queue and used > least:
            _, b = heapq.heappop(queue)
            while b in bins and used > least and (change := loose.best(b)):
                a, new_a, new_b = change
                n = bins[a] // 2 if a == b else min(bins[a], bins[b])
                loose.add(a, -n), loose.add(b, -n), loose.add(new_a, n), loose.add(new_b, n)
                changed = True
                used -= 0 if new_a else n
                for p in filter(None, (new_a, new_b)):
                    if sum(p) < capacity:
                        heapq.heappush(queue, (capacity - sum(p), p))
    return bins


class Plan:
    """Where the piece of each length and rank goes."""

    def __init__(self, bins: Counter):
        slots = []
        first = 0
        for pattern, n in sorted(bins.items(), reverse=True):
            offset = 0
            for length in pattern:
                slots.append((length, n, first, offset))
                offset += length
            first += n
        slots.sort()
        self.sequences = first
        lengths = np.array([s[0] for s in slots], np.int64)
        copies = np.array([s[1] for s in slots], np.int64)
        ends = np.cumsum(copies)
        self.base = {int(x): int(ends[i - 1]) if i else 0 for x, i in zip(*np.unique(lengths, return_index=True), strict=True)}
        self.starts, self.first, self.offset = ends - copies, np.array([s[2] for s in slots], np.int64), np.array([s[3] for s in slots], np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the pieces with these lengths and ranks (from 0)."""
        at = pd.Series(length).map(self.base).to_numpy(np.int64) + rank
        slot = np.searchsorted(self.starts, at, side="right") - 1
        return self.first[slot] + at - self.starts[slot], self.offset[slot]


def solve(counts: dict[int, int], capacity: int) -> Plan:
    return Plan(local_search(apart(counts), capacity))


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, cut: str | None = "bytes") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than a sequence in full pieces but the first."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer, cut)
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], coder.encode(list(b["text"]), end), strict=True):
                n = -(-len(ids) // capacity)
                cuts = [0, *range(len(ids) - (n - 1) * capacity, len(ids) + 1, capacity)]
                rows += [(doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(lean(work, "encoder"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, cut: str | None = "bytes", rows_per_group: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every token of every document once, in sequences of at most `capacity`.

    A length that a third of all pieces have is ranked in groups of about rows_per_group rows, salted
    by a hash; a group's ranks begin where those before it end. Defined cases: null or empty text is
    the end id alone; rows that share a doc_id are packed each; null doc_ids are packed like others;
    an empty table gives an empty one; other columns are not looked at.
    """
    pieces = checkpoint(pieces_of(docs, tokenizer, capacity, end, cut))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = solve(counts, capacity)
    groups = max(16, sum(counts.values()) // rows_per_group)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(sizes, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("salt", "before")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["sequence_id"], b["offset"] = plan.place(b["length"].to_numpy(), b.pop("rank").to_numpy())
            yield b[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(lean(work), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
