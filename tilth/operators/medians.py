"""Exact medians by counting, without a task that holds all values.

A median by narrowing counts values in equal bins of what is left of the range, keeps the bin that
holds the middle rank, and ends when that bin has one value or few enough to look at. Every step is
one scan of the columns at hand with a small, combined shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.semantics import finite

BINS = 4096
#: So many values of a last bin are looked at one by one.
FEW = 10_000


class _Search:
    """Where the middle ranks of one column still may be: lo to hi, with `below` values under lo."""

    def __init__(self, n: int, lo: float, hi: float):
        self.lo, self.hi, self.below, self.inside = lo, hi, 0, n
        self.ranks = [(n - 1) // 2, n // 2] if n else []
        self.found: dict[int, float] = {}
        self._settle()

    def _settle(self) -> None:
        if self.ranks and self.lo == self.hi:
            self.found.update(dict.fromkeys(self.ranks, self.lo))

    @property
    def open(self) -> bool:
        return any(r not in self.found for r in self.ranks)

    @property
    def median(self) -> float | None:
        return sum(self.found[r] for r in self.ranks) / 2 if self.ranks else None

    def narrow(self, bins: list[tuple[int, float, float]]) -> None:
        """bins: (count, least, most) of what is inside, rising."""
        at, spans = self.below, []
        for n, least, most in bins:
            for r in self.ranks:
                if at <= r < at + n:
                    spans.append((at, n, least, most))
                    if r == at:
                        self.found[r] = least
                    elif r == at + n - 1:
                        self.found[r] = most
            at += n
        wanted = [s for r, s in zip(self.ranks, spans, strict=True) if r not in self.found]
        if wanted:
            self.below, self.inside, self.lo, self.hi = wanted[0]
            self._settle()

    def look(self, values: list[float]) -> None:
        """values: all that are inside, rising."""
        for r in self.ranks:
            if r not in self.found:
                self.found[r] = values[r - self.below]


def medians(df: DataFrame, columns: dict[str, Column], bins: int = BINS, few: int = FEW) -> dict[str, float | None]:
    """The exact median of each column's finite values, all columns in the same scans; None where there are none."""
    names = list(columns)
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), columns[c].cast("double").alias("v")) for i, c in enumerate(names)])).alias("s")).select("s.i", "s.v").filter(finite(F.col("v")))
    start = {r["i"]: r for r in values.groupBy("i").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}  # a row a column
    search = [_Search(start[i]["n"], start[i]["lo"], start[i]["hi"]) if i in start else _Search(0, 0.0, 0.0) for i in range(len(names))]
    while open_ := [i for i, s in enumerate(search) if s.open]:
        inside = F.lit(False)
        bin_ = F.lit(None).cast("int")
        for i in open_:
            s = search[i]
            own = (F.col("i") == i) & F.col("v").between(s.lo, s.hi)
            inside = inside | own
            bin_ = F.when(own, F.least(F.floor((F.col("v") / 2 - s.lo / 2) / (s.hi / 2 - s.lo / 2) * bins), F.lit(bins - 1)).cast("int")).otherwise(bin_)
        left = values.filter(inside)
        small = [i for i in open_ if search[i].inside <= few]
        if small:
            got: dict[int, list[float]] = {i: [] for i in small}
            for r in left.filter(F.col("i").isin(small)).collect():  # at most `few` rows a column
                got[r["i"]].append(r["v"])
            for i in small:
                search[i].look(sorted(got[i]))
        if large := [i for i in open_ if i not in small]:
            counted: dict[int, list] = {i: [] for i in large}
            for r in left.filter(F.col("i").isin(large)).groupBy("i", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # at most `bins` rows a column
                counted[r["i"]].append((r["bin"], (r["n"], r["lo"], r["hi"])))
            for i in large:
                search[i].narrow([b for _, b in sorted(counted[i])])
    return {c: s.median for c, s in zip(names, search, strict=True)}


def group_medians(df: DataFrame, keys: list[str], value: str, alias: str = "median", bins: int = 1024) -> DataFrame:
    """keys and the exact median of value (finite ones) of every group.

    Each group's range is counted in bins; only the rows of the bins that hold its middle ranks are
    ordered, so a group of any size leaves a small part of itself to sort. Nulls among the keys are
    groups of their own.
    """
    own = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(finite(F.col("_v")))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    spans = own.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    placed = own.alias("a").join(spans.alias("b"), same("a", "b")).select("a.*", "_lo", "_hi", "_n")
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins), F.lit(bins - 1))).otherwise(0)
    placed = placed.withColumn("_bin", at.cast("int"))
    counts = placed.groupBy(*keys, "_bin").agg(F.count("*").alias("_in"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows a group
    counts = counts.withColumn("_below", F.coalesce(F.sum("_in").over(w), F.lit(0)))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_in"))
    middle = counts.filter(holds(low) | holds(high)).select(*keys, "_bin", "_below")
    rows = placed.alias("a").join(middle.alias("b"), [*same("a", "b"), F.col("a._bin") == F.col("b._bin")]).select("a.*", "_below")
    ranked = rows.withColumn("_rank", F.col("_below") + F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_v")) - 1)
    return ranked.filter((F.col("_rank") == low) | (F.col("_rank") == high)).groupBy(*keys).agg(F.avg("_v").alias(alias))
