"""Relational parts of zoning: neighbours, profiles, cuts, summaries, residual structures by zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.semantics import number, require_columns

STEPS = {"rook": ((1, 0), (0, 1)), "queen": ((1, 0), (0, 1), (1, 1), (1, -1))}


def cell_neighbours(cells: DataFrame, kind: str = "rook") -> DataFrame:
    """row, col, row2, col2 of neighbouring cells, each pair once: an equi-join on shifted places."""
    require_columns(cells, "row", "col")
    own = cells.select("row", "col").distinct()
    shifts = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in STEPS[kind]])
    moved = own.withColumn("s", F.explode(shifts)).select("row", "col", (F.col("row") + F.col("s.r")).alias("row2"), (F.col("col") + F.col("s.c")).alias("col2"))
    return moved.join(own.select(F.col("row").alias("row2"), F.col("col").alias("col2")), ["row2", "col2"]).select("row", "col", "row2", "col2")


def profile(data: DataFrame, response: str, along: str) -> DataFrame:
    """along, mean, n and the running sums from which any segment's squares follow."""
    require_columns(data, response, along)
    v = number(response)
    p = data.filter(v.isNotNull() & F.col(along).isNotNull()).groupBy(F.col(along).alias("along")).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("along").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as positions
    return p.select("along", "mean", "n", F.sum("n").over(w).alias("cum_n"), F.sum(F.col("n") * F.col("mean")).over(w).alias("cum_sum"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).over(w).alias("cum_sq"))


def profile_semivariance(data: DataFrame, response: str, along: str, max_lag: int) -> DataFrame:
    """lag, gamma, n_pair of the profile's means by rank of position."""
    p = profile(data, response, along).select("mean", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("along")).alias("k"))
    ahead = p.select(F.col("mean").alias("later"), "k").withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("k", F.col("k") - F.col("lag"))
    return p.join(ahead, "k").groupBy("lag").agg((F.avg(F.pow(F.col("mean") - F.col("later"), 2)) / 2).alias("gamma"), F.count("*").alias("n_pair"))


def best_rectangle_cut(cells: DataFrame, value: str, region: str, min_cells: int = 5) -> DataFrame:
    """Of each region: axis, cut (the last coordinate of the lower part) and gain, the fall in squared deviations.

    Candidates come from running sums over the row and column totals. Ties: rows first, then the smaller cut.
    """
    require_columns(cells, value, region, "row", "col")
    v = number(value)
    totals = None
    for place, axis in ((1, "row"), (2, "col")):
        t = cells.groupBy(F.col(region).alias("region"), F.lit(place).alias("place"), F.lit(axis).alias("axis"), F.col(axis).alias("cut")).agg(F.count(v).alias("n"), F.sum(v).alias("s"))
        totals = t if totals is None else totals.unionByName(t)
    by = Window.partitionBy("region", "place")
    run = by.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    c = totals.select("*", F.sum("n").over(run).alias("n1"), F.sum("s").over(run).alias("s1"), F.sum("n").over(by).alias("nt"), F.sum("s").over(by).alias("st"))
    n2, s2 = F.col("nt") - F.col("n1"), F.col("st") - F.col("s1")
    gain = F.col("s1") * F.col("s1") / F.col("n1") + s2 * s2 / n2 - F.col("st") * F.col("st") / F.col("nt")
    c = c.filter((F.col("n1") >= min_cells) & (n2 >= min_cells)).withColumn("gain", gain)
    top = c.groupBy("region").agg(F.min(F.struct((-F.col("gain")).alias("less"), "place", "cut", "axis")).alias("t"))
    return top.select("region", F.col("t.axis").alias("axis"), F.col("t.cut").alias("cut"), (-F.col("t.less")).alias("gain"))


def zone_summary(cells: DataFrame, zone: str, covariates: list[str], treat: str | None = None, cell_area: float = 1.0) -> DataFrame:
    """zone, cells, area, mean of each covariate, and how many treatments the zone has."""
    require_columns(cells, zone, treat, *covariates)
    more = [F.count_distinct(treat).alias("treatments")] if treat else []
    return cells.groupBy(F.col(zone).alias("zone")).agg(F.count("*").alias("cells"), (F.count("*") * F.lit(float(cell_area))).alias("area"), *[F.avg(number(c)).alias(f"mean_{c}") for c in covariates], *more)


def adaptive_residual(data: DataFrame, zone: str = "zone", row: str = "row", col: str = "col") -> DataFrame:
    """zone and its residual structure: ar1 over an axis with two levels or more, else id."""
    require_columns(data, zone, row, col)
    part = lambda c: F.when(F.count_distinct(c) >= 2, f"ar1({c})").otherwise(f"id({c})")
    return data.groupBy(F.col(zone).alias("zone")).agg(F.concat(part(row), F.lit(":"), part(col)).alias("structure"))


def residual_formula(structures: DataFrame, zone: str = "zone") -> str:
    """One dsum term for each distinct structure, zones in order."""
    groups: dict[str, list[str]] = {}
    for r in structures.orderBy("zone").collect():  # one row a zone
        groups.setdefault(r["structure"], []).append(str(r["zone"]))
    if len(groups) == 1 and len(next(iter(groups.values()))) == 1:
        return f"~ {next(iter(groups))}"
    levels = lambda zs: "" if len(groups) == 1 else ", levels = [" + ", ".join(zs) + "]"
    return "~ " + " + ".join(f"dsum(~ {s} | {zone}{levels(zs)})" for s, zs in groups.items())
