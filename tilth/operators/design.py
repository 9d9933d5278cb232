"""Trial designs, count stations and sampling plans."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilth.semantics import keyed_uniform, require_columns


def make_trial_design(spark: SparkSession, treatments: list[str], n_rep: int = 4, layout: str = "strip", plot_width: float = 18.0, plot_length: float = 200.0, cell_size: float = 9.0, gap: float = 0.0, randomise: bool = True, origin: tuple[float, float] = (0.0, 0.0), seed: int = 1) -> DataFrame:
    """row, col, x, y, treat, rep, plot, tier of every cell: a randomised complete block design.

    Plots stand side by side in strips of plot_length, or in two tiers of a stack with a gap between,
    whose cells belong to no plot. Within a replicate treatments are ordered by a hash of seed,
    replicate and treatment.
    """
    if len(set(treatments)) < 2:
        raise ValueError("at least two treatments are needed")
    if cell_size > plot_width:
        raise ValueError("a cell must not be wider than a plot")
    n_plots, tiers = len(treatments) * n_rep, 2 if layout == "stack" else 1
    if n_plots % tiers:
        raise ValueError("a stack needs an even number of plots")
    per_tier = n_plots // tiers
    reps = spark.range(n_rep).select((F.col("id") + 1).cast("int").alias("rep"))
    names = spark.createDataFrame(list(enumerate(treatments)), "place int, treat string")
    key = keyed_uniform(F.lit(seed), F.col("rep"), F.col("treat")) if randomise else F.col("place").cast("double")
    book = reps.join(F.broadcast(names)).withColumn("plot", ((F.col("rep") - 1) * len(treatments) + F.row_number().over(Window.partitionBy("rep").orderBy(key, "place"))).cast("int"))
    book = book.select("plot", "rep", "treat", (F.floor((F.col("plot") - 1) / per_tier) + 1).cast("int").alias("tier"), (F.pmod(F.col("plot") - 1, F.lit(per_tier)) + 1).cast("int").alias("place"))
    height = plot_length * tiers + gap * (tiers - 1)
    n_col, n_row = math.floor(per_tier * plot_width / cell_size), math.floor(height / cell_size)
    rel_x, rel_y = (F.col("col") - 0.5) * cell_size, (F.col("row") - 0.5) * cell_size
    cells = spark.range(n_row * n_col).select((F.floor(F.col("id") / n_col) + 1).cast("int").alias("row"), (F.col("id") % n_col + 1).cast("int").alias("col"))
    tier = F.when(rel_y <= plot_length, 1).when((rel_y > plot_length + gap) & F.lit(tiers == 2), 2)
    cells = cells.withColumns({"x": rel_x + origin[0], "y": rel_y + origin[1], "tier": tier, "place": (F.floor(rel_x / plot_width) + 1).cast("int")})
    return cells.join(F.broadcast(book), ["tier", "place"], "left").select("row", "col", "x", "y", "treat", "rep", "plot", "tier")


def _plots(design: DataFrame, cell_size: float | None, plot_width: float | None, plot_length: float | None, gap: float) -> DataFrame:
    """plot, tier, treat, rep and the corners x0, x1, y0, y1 of every plot: as planned where its size is given, else the extent of its cells."""
    if cell_size is None:
        steps = design.select("x").distinct().select((F.col("x") - F.lag("x").over(Window.orderBy("x"))).alias("d"))  # a row a column of the lattice
        cell_size = steps.agg(F.min("d")).first()[0] or 1.0
    half = cell_size / 2
    own = design.filter("plot is not null and treat is not null")
    plots = own.groupBy("plot", "tier", "treat", "rep").agg((F.min("x") - half).alias("x0"), (F.max("x") + half).alias("x1"), (F.min("y") - half).alias("y0"), (F.max("y") + half).alias("y1"))
    if plot_width is None or plot_length is None:
        return plots
    corner = design.agg((F.min("x") - half).alias("ox"), (F.min("y") - half).alias("oy"))
    place = F.col("plot") - F.min("plot").over(Window.partitionBy("tier"))
    x0, y0 = F.col("ox") + place * plot_width, F.col("oy") + (F.col("tier") - 1) * (plot_length + gap)
    return plots.join(F.broadcast(corner)).select("plot", "tier", "treat", "rep", x0.alias("x0"), (x0 + plot_width).alias("x1"), y0.alias("y0"), (y0 + plot_length).alias("y1"))


def place_count_stations(
    design: DataFrame, n_stations: int = 8, n_quadrats: int = 2, end_buffer: float = 20.0, side_buffer: float = 2.0, quadrat_spread: float = 2.5, layout: str = "systematic", same_positions: bool = True,
    cell_size: float | None = None, plot_width: float | None = None, plot_length: float | None = None, gap: float = 0.0, start: float | None = None, seed: int = 1,
) -> DataFrame:
    """plot, tier, treat, rep, station, quadrat, x, y, along: quadrats at stations along every plot.

    systematic: station k stands at (k - 1 + u) steps of the length between the end buffers, u being
    `start`, or one number for all plots, or with same_positions=False one for each. random: anywhere
    there, in rising order. Where a station has several quadrats, each lies up to quadrat_spread
    before or after it, but between the buffers; across, quadrats lie anywhere between the side
    buffers. All numbers are hashes of seed, plot, station and quadrat. ValueError where the buffers
    leave no room.
    """
    require_columns(design, "plot", "tier", "treat", "rep", "x", "y")
    if layout not in ("systematic", "random"):
        raise ValueError(f"unknown layout: {layout}")
    if n_stations < 1 or n_quadrats < 1 or min(end_buffer, side_buffer, quadrat_spread) < 0:
        raise ValueError("stations and quadrats must be positive, buffers and spread not negative")
    plots = _plots(design, cell_size, plot_width, plot_length, gap)
    least = plots.agg(F.min(F.col("y1") - F.col("y0")).alias("length"), F.min(F.col("x1") - F.col("x0")).alias("width")).first()
    if least["length"] is not None and (least["length"] <= 2 * end_buffer or least["width"] <= 2 * side_buffer):
        raise ValueError(f"the buffers leave no room in the smallest plot ({least['length']:g} by {least['width']:g} m)")
    u = lambda *keys: keyed_uniform(F.lit(seed), *keys)
    usable = F.col("y1") - F.col("y0") - 2 * end_buffer
    out = plots.withColumn("station", F.explode(F.sequence(F.lit(1), F.lit(n_stations))))
    if layout == "systematic":
        first = F.lit(float(start)) if start is not None else u(F.lit("start")) if same_positions else u(F.lit("start"), F.col("plot"))
        out = out.withColumn("at", end_buffer + (F.col("station") - 1 + first) * usable / n_stations)
    else:
        at = out.withColumn("at", end_buffer + u(F.lit("along"), F.col("plot"), F.col("station")) * usable)
        out = at.withColumn("station", F.row_number().over(Window.partitionBy("plot", "tier").orderBy("at", "station")))
    out = out.withColumn("quadrat", F.explode(F.sequence(F.lit(1), F.lit(n_quadrats))))
    keys = (F.col("plot"), F.col("station"), F.col("quadrat"))
    along = F.col("at") + (2 * u(F.lit("y"), *keys) - 1) * quadrat_spread if n_quadrats > 1 else F.col("at")
    along = F.least(F.greatest(along, F.lit(float(end_buffer))), F.col("y1") - F.col("y0") - end_buffer)
    x = F.col("x0") + side_buffer + u(F.lit("x"), *keys) * (F.col("x1") - F.col("x0") - 2 * side_buffer)
    return out.select("plot", "tier", "treat", "rep", "station", "quadrat", x.alias("x"), (F.col("y0") + along).alias("y"), along.alias("along"))


def _evenly(low: float, high: float, n: int) -> list[float]:
    return [(low + high) / 2] if n == 1 else [low + (high - low) * i / (n - 1) for i in range(n)]


def _uniform(*keys) -> float:
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32


def place_point_samples(grid: DataFrame, n: int, design: str = "random", x: str = "x", y: str = "y", strata: str | None = None, spacings: list[float] | None = None, seed: int = 1) -> DataFrame:
    """n rows of grid: by a keyed shuffle, on a rectangle of targets, in blocks along y within strata, or nested.

    'grid' snaps targets spread from edge to edge to their nearest cells; 'stratified' takes one cell
    of each block and stratum; 'nested' starts from centres inside the trial and adds cells at each of
    `spacings` from them, in turn and in random directions (0.05, 0.12 and 0.28 of the extent unless
    given). All are topped up, or cut, to n by the keyed shuffle. Fewer cells than n are an error.
    """
    require_columns(grid, x, y, strata)
    if n < 1:
        raise ValueError("n must be positive")
    own = grid.withColumn("_u", keyed_uniform(F.lit(seed), F.col(x), F.col(y)))
    x0, x1, y0, y1, cells = own.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count("*")).first()
    if cells < n:
        raise ValueError(f"{n} samples asked for, {cells} cells there")
    sx, sy = x1 - x0, y1 - y0
    spark = grid.sparkSession
    targets: list[tuple[float, float]] = []
    if design == "grid" and sx > 0 and sy > 0:
        n_x = max(2, round(math.sqrt(n * sx / sy)))
        targets = [(a, b) for b in _evenly(y0, y1, max(2, math.ceil(n / n_x))) for a in _evenly(x0, x1, n_x)]
    elif design == "nested":
        far = list(spacings) if spacings else [max(sx, sy) * s for s in (0.05, 0.12, 0.28)]
        wanted = max(2, math.ceil(n / (len(far) + 1)))
        k_x = max(1, round(math.sqrt(wanted * max(sx, 1.0) / max(sy, 1.0))))
        inset = lambda lo, hi: (min(lo + 0.6 * max(far), (lo + hi) / 2), max(hi - 0.6 * max(far), (lo + hi) / 2))
        centres = [(a, b) for b in _evenly(*inset(y0, y1), max(1, math.ceil(wanted / k_x))) for a in _evenly(*inset(x0, x1), k_x)][:wanted]
        targets = list(centres)
        for stage in range(4 * len(far)):
            if len(targets) >= n:
                break
            for i, (a, b) in enumerate(centres):
                turn = 2 * math.pi * _uniform(seed, "turn", stage, i)
                targets.append((a + far[stage % len(far)] * math.cos(turn), b + far[stage % len(far)] * math.sin(turn)))
    elif design not in ("random", "grid", "stratified"):
        raise ValueError(f"unknown design: {design}")
    if targets:
        wanted_at = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(targets)], "_t int, _tx double, _ty double")
        gap = F.pow(F.col(x) - F.col("_tx"), 2) + F.pow(F.col(y) - F.col("_ty"), 2)
        nearest = own.select(x, y).join(F.broadcast(wanted_at)).groupBy("_t").agg(F.min(F.struct(gap.alias("d"), F.col(y).alias("y"), F.col(x).alias("x"))).alias("at"))  # about as many targets as samples
        hits = nearest.groupBy(F.col("at.x").alias("_hx"), F.col("at.y").alias("_hy")).agg(F.min("_t").alias("_t"))
        first = own.join(F.broadcast(hits), (F.col(x) == F.col("_hx")) & (F.col(y) == F.col("_hy")), "left").withColumn("_first", F.coalesce("_t", F.lit(len(targets)))).drop("_hx", "_hy", "_t")
        if design == "grid":
            first = first.withColumn("_first", (F.col("_first") == len(targets)).cast("int"))
    elif design == "stratified":
        groups = [F.col(strata)] if strata else [F.lit(1)]
        blocks = max(1, n // max(1, own.select(*groups).distinct().count()))
        block = F.least(F.greatest(F.ceil((F.col(y) - y0) / (max(sy, 1e-9) / blocks)), F.lit(1)), F.lit(blocks))
        w = Window.partitionBy(*groups, block).orderBy("_u", x, y)
        first = own.withColumn("_first", F.when(F.row_number().over(w) == 1, 1).otherwise(2))
    else:
        first = own.withColumn("_first", F.lit(1))
    return first.orderBy("_first", "_u", x, y).limit(n).drop("_first", "_u")
