"""An extension: the stateless cleaning rules and windowed gridding over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.semantics import holds, number


def clean_stream(points: DataFrame, yield_: str = "yield", x: str = "x", y: str = "y", speed: str | None = None, yield_range: tuple[float, float] | None = None) -> DataFrame:
    """Rows that need no other row to be judged: a place and a yield, in range, moving."""
    bad = number(yield_).isNull() | number(x).isNull() | number(y).isNull()
    if yield_range:
        bad = bad | holds((number(yield_) < yield_range[0]) | (number(yield_) > yield_range[1]))
    if speed:
        bad = bad | holds(number(speed) <= 0)
    return points.filter(~bad)


def grid_stream(points: DataFrame, time: str, response: str, x: str = "x", y: str = "y", cell_size: float = 5.0, origin: tuple[float, float] = (0.0, 0.0), window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, row, col, response, n_obs in tumbling windows; points later than the watermark are left out."""
    cell = lambda c, v0: (F.floor((number(c) - v0) / cell_size) + 1).cast("int")
    g = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), cell(y, origin[1]).alias("row"), cell(x, origin[0]).alias("col"))
    return g.agg(F.avg(number(response)).alias(response), F.count(number(response)).alias("n_obs")).select(F.col("w.start").alias("start"), "row", "col", response, "n_obs")
