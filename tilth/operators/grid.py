"""Dense layers onto lattices: cells, purity, and the choice of a cell size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.semantics import finite, half_even, keyed_uniform, number, require_columns

#: How a cell's response follows from partial figures of its parts (count c, sum s, least lo, most hi), so one shuffle serves it and the purity.
COMBINED = {"mean": lambda: F.try_divide(F.sum("s"), F.sum("c")), "sum": lambda: F.sum("s"), "min": lambda: F.min("lo"), "max": lambda: F.max("hi")}
#: Multiples of the usual distance between neighbours that are tried as cell sizes. Fixed values.
SIZE_STEPS = (1, 2, 3, 5, 8, 12, 20)


def _placed(data: DataFrame, x: str, y: str, response: str, treat: str | None) -> DataFrame:
    """x, y, response and treat of the rows with finite places."""
    own = data.select(number(x).alias("x"), number(y).alias("y"), number(response).alias("response"), (F.col(treat) if treat else F.lit(None)).cast("string").alias("treat"))
    return own.filter(finite(F.col("x")) & finite(F.col("y")))


def _box(own: DataFrame) -> DataFrame:
    """One row: the corners of the places."""
    return own.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def _cell(v: str, v0: str, size):
    return (F.floor((F.col(v) - F.col(v0)) / size) + 1).cast("int")


def grid_dense_layer(data: DataFrame, x: str, y: str, response: str, treat: str | None = None, cell_size: float = 5.0, fun: str | Callable[[pd.Series], float] = "mean", n_min: int = 1, keep_empty: bool = True) -> DataFrame:
    """row, col, x_centre, y_centre, response, n_obs and, with treat, treat and treat_purity.

    Cells count from the smallest corner. fun: 'mean', 'sum', 'min', 'max', 'median', or a function of a
    cell's responses (a pandas series without nulls), which then meet in one place. A cell's treatment
    is its most frequent one (ties: the first by name), its purity that one's share. Under n_min
    observations the response is null. With keep_empty all cells of the rectangle are there. Rows
    come in no order; orderBy("row", "col") is the lattice's.
    """
    require_columns(data, x, y, response, treat)
    if not cell_size > 0:
        raise ValueError("cell_size must be positive")
    size = float(cell_size)
    own = _placed(data, x, y, response, treat)
    box = _box(own)
    binned = own.join(F.broadcast(box.select("x0", "y0"))).withColumns({"row": _cell("y", "y0", size), "col": _cell("x", "x0", size)})  # one row
    parts = binned.groupBy("row", "col", "treat").agg(F.count("*").alias("n"), F.count("response").alias("c"), F.sum("response").alias("s"), F.min("response").alias("lo"), F.max("response").alias("hi"))
    votes = F.min(F.when(F.col("treat").isNotNull(), F.struct((-F.col("n")).alias("less"), "treat")))
    value = COMBINED[fun]() if fun in COMBINED else F.lit(None).cast("double")
    cells = parts.groupBy("row", "col").agg(value.alias("value"), F.sum("c").alias("n_obs"), votes.alias("top"), F.sum(F.when(F.col("treat").isNotNull(), F.col("n"))).alias("all"))
    if fun not in COMBINED:
        how = F.median("response") if fun == "median" else F.pandas_udf(lambda v: float(fun(v)), "double", F.PandasUDFType.GROUPED_AGG)("response")
        cells = cells.drop("value").join(binned.filter("response is not null").groupBy("row", "col").agg(how.alias("value")), ["row", "col"], "left")
    corner = box.select("x0", "y0", _cell("y1", "y0", size).alias("rows"), _cell("x1", "x0", size).alias("cols")).filter("rows is not null")
    if keep_empty:
        lattice = corner.select("x0", "y0", "cols", F.explode(F.sequence(F.lit(1), "rows")).alias("row")).select("x0", "y0", "row", F.explode(F.sequence(F.lit(1), "cols")).alias("col"))
        cells = lattice.join(cells, ["row", "col"], "left")
    else:
        cells = cells.join(F.broadcast(corner))
    n = F.coalesce("n_obs", F.lit(0))
    return cells.select(
        "row", "col", (F.col("x0") + (F.col("col") - 0.5) * size).alias("x_centre"), (F.col("y0") + (F.col("row") - 0.5) * size).alias("y_centre"),
        F.when(n >= n_min, F.col("value")).alias(response), n.alias("n_obs"), *([F.col("top.treat").alias("treat"), (-F.col("top.less") / F.col("all")).alias("treat_purity")] if treat else []),
    )


def default_sizes(data: DataFrame, x: str, y: str, sample: int = 400) -> list[float]:
    """Multiples of the median distance to the nearest neighbour among at most `sample` rows, those of the smallest hashes."""
    own = data.select(number(x).alias("x"), number(y).alias("y")).filter(finite(F.col("x")) & finite(F.col("y")))
    some = own.orderBy(keyed_uniform(F.col("x"), F.col("y")), "x", "y").limit(sample).toPandas().to_numpy(float)
    if len(some) < 2:
        raise ValueError("sizes are needed: there are too few places to find one")
    far = np.hypot(*(some[:, None] - some[None]).transpose(2, 0, 1))
    np.fill_diagonal(far, np.inf)
    step = float(np.median(far.min(axis=1)))
    return sorted({round(step * k, 1) for k in SIZE_STEPS})


def choose_cell_size(data: DataFrame, response: str, x: str, y: str, treat: str | None = None, sizes: list[float] | None = None, min_obs: float = 3, min_purity: float = 0.7) -> DataFrame:
    """cell_size, cells, occupied, coverage, median_obs, pure, usable and chosen, for each size, in one pass over the exploded sizes.

    cells: of the whole lattice; occupied: those with a response, which all that follows is about;
    coverage: their share; pure: the share with one treatment only (null without treat); usable: how
    many have min_obs responses or more, and one treatment. The smallest size whose median_obs and
    pure reach min_obs and min_purity is chosen. Sizes: default_sizes unless given.
    """
    require_columns(data, response, x, y, treat)
    sizes = sorted({float(s) for s in (sizes if sizes is not None else default_sizes(data, x, y)) if s > 0})
    if not sizes:
        raise ValueError("sizes must hold a positive number")
    own = _placed(data, x, y, response, treat)
    each = F.explode(F.array(*[F.lit(s) for s in sizes]))
    box = _box(own)
    size = F.col("cell_size")
    cells = (
        own.join(F.broadcast(box.select("x0", "y0")))
        .withColumn("cell_size", each)
        .groupBy("cell_size", _cell("y", "y0", size).alias("row"), _cell("x", "x0", size).alias("col"))
        .agg(F.count("response").alias("n"), (F.min("treat") == F.max("treat")).alias("one"))
        .filter("n > 0")
    )
    share = lambda c: half_even(c, 3)
    enough = F.col("n") >= min_obs
    usable = enough & F.col("one") if treat else enough
    table = cells.groupBy("cell_size").agg(F.count("*").alias("occupied"), F.median("n").alias("median_obs"), share(F.avg(F.col("one").cast("double"))).alias("pure"), F.count_if(usable).alias("usable"))
    lattice = box.withColumn("cell_size", each).select("cell_size", (_cell("y1", "y0", size).cast("long") * _cell("x1", "x0", size)).alias("cells"))
    table = lattice.join(table, "cell_size").withColumn("coverage", share(F.col("occupied") / F.col("cells")))
    good = (F.col("median_obs") >= min_obs) & F.coalesce(F.col("pure") >= min_purity, F.lit(True))
    least = F.min(F.when(good, F.col("cell_size"))).over(Window.partitionBy(F.lit(1)))  # as many rows as sizes
    return table.select("cell_size", "cells", "occupied", "coverage", "median_obs", "pure", "usable", F.coalesce(F.col("cell_size") == least, F.lit(False)).alias("chosen"))
