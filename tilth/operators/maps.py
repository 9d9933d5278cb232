"""Maps and plans as rows of rectangles, labels and marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.functions.colours import MISSING, ink_on, ofe_palette, ramp
from tilth.semantics import number, require_columns

PLACES = (("x", "y"), ("x_centre", "y_centre"), ("col", "row"))


def places_of(data: DataFrame) -> tuple[str, str]:
    """The columns that hold the places."""
    found = next(((a, b) for a, b in PLACES if a in data.columns and b in data.columns), None)
    if found is None:
        raise ValueError("Column(s) not found: x, y")
    return found


def spacing(data: DataFrame, x: str, y: str, chunk: float = 1024.0) -> float:
    """The most frequent gap between neighbouring values of x or y (to eight significant digits), the smaller one; 1 if there is none.

    Distinct values are ordered in stretches, not all in one task: gaps within stretches of the range,
    then those between the ends of stretches.
    """
    sizes = []
    for c in (x, y):
        v = data.select(number(c).alias("v")).dropna().distinct()
        r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        if r["lo"] is None or r["lo"] == r["hi"]:
            continue
        part = v.withColumn("k", F.floor((F.col("v") - r["lo"]) / (r["hi"] - r["lo"]) * chunk))
        inner = part.select((F.col("v") - F.lag("v").over(Window.partitionBy("k").orderBy("v"))).alias("g"))
        ends = part.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        between = ends.select((F.col("lo") - F.lag("hi").over(Window.orderBy("k"))).alias("g"))  # a row a stretch
        g = inner.unionByName(between).dropna()
        digits = (7 - F.floor(F.log10("g"))).cast("int")
        g = g.select((F.round(F.col("g") * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
        sizes.append(g.agg(F.min(F.struct((-F.col("n")).alias("n"), "g"))["g"].alias("g")).first()["g"])
    return min(sizes) if sizes else 1.0


def _kind(data: DataFrame, value: str, type: str) -> str:
    if type == "auto":
        return "categorical" if isinstance(data.schema[value].dataType, (T.StringType, T.BooleanType)) else "sequential"
    if type not in ("sequential", "diverging", "categorical"):
        raise ValueError(f"unknown type: {type}")
    return type


def map_key(data: DataFrame, value: str, type: str = "auto", n: int = 64, palette: list[str] | None = None) -> DataFrame:
    """place, label, low, high, fill: a row for each level, or for each of n steps from the least value to the most."""
    require_columns(data, value)
    spark, type = data.sparkSession, _kind(data, value, type)
    schema = "place int, label string, low double, high double, fill string"
    if type == "categorical":
        levels = data.select(F.col(value).cast("string").alias("label")).dropna().distinct()
        count = levels.count()
        fills = [palette[i % len(palette)] for i in range(count)] if palette else ofe_palette("treatment", max(count, 1))
        colours = spark.createDataFrame(list(enumerate(fills)), "place int, fill string")
        ranked = levels.withColumn("place", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))  # a row a level
        return ranked.join(colours, "place").select("place", "label", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "fill")
    lo, hi = data.agg(F.min(number(value)), F.max(number(value))).first()
    lo, hi = (0.0, 1.0) if lo is None else (lo, hi)
    if type == "diverging":
        hi = max(abs(lo), abs(hi))
        lo = -hi
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    fills = ramp(tuple(palette), n) if palette else ofe_palette("residual" if type == "diverging" else "surface", n)
    at = [lo + (hi - lo) * i / n for i in range(n + 1)]
    return spark.createDataFrame([(i, None, at[i], at[i + 1], f) for i, f in enumerate(fills)], schema)


def ofe_map(data: DataFrame, value: str, type: str = "auto", n: int = 64, palette: list[str] | None = None, cell: float | None = None, x: str | None = None, y: str | None = None, overlay: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """xmin, xmax, ymin, ymax, value, fill of every cell; map_key gives the legend.

    auto: categorical for text and booleans, else sequential; diverging, with equal limits both ways,
    only if asked for. Steps are right-closed. A null has a fill of its own. overlay: given the map's
    rows, returns rows to draw over them (the same columns, or some and others).
    """
    require_columns(data, value, x, y)
    type = _kind(data, value, type)
    xy = places_of(data) if x is None or y is None else (x, y)
    half = (cell or spacing(data, *xy)) / 2
    key = map_key(data, value, type, n, palette)
    px, py = number(xy[0]), number(xy[1])
    if type == "categorical":
        legend = key.select(F.col("label").alias("_label"), F.col("fill").alias("_fill"))
        own, fill = data.join(legend, F.col(value).cast("string") == F.col("_label"), "left"), F.col("_fill")
    else:
        steps = key.orderBy("place").collect()  # n rows
        lo, hi = steps[0]["low"], steps[-1]["high"]
        step = F.least(F.greatest(F.ceil((number(value) - lo) / (hi - lo) * n) - 1, F.lit(0)), F.lit(n - 1))
        own, fill = data, F.get(F.array(*[F.lit(s["fill"]) for s in steps]), step.cast("int"))
    out = own.select((px - half).alias("xmin"), (px + half).alias("xmax"), (py - half).alias("ymin"), (py + half).alias("ymax"), F.col(value).alias("value"), F.coalesce(fill, F.lit(MISSING)).alias("fill"))
    return out.unionByName(overlay(out), allowMissingColumns=True) if overlay else out


MARKS = "kind string, xmin double, xmax double, ymin double, ymax double, label string, fill string, ink string"


def _marks(df: DataFrame, kind: str, box: tuple, label, fill, ink) -> DataFrame:
    lit = lambda v: F.lit(None).cast("string") if v is None else v
    return df.select(F.lit(kind).alias("kind"), *[b.cast("double").alias(n) for b, n in zip(box, ("xmin", "xmax", "ymin", "ymax"), strict=True)], lit(label).cast("string").alias("label"), lit(fill).alias("fill"), lit(ink).alias("ink"))


def _coloured(df: DataFrame, by: str, palette: str) -> DataFrame:
    """df with fill and ink of each level of `by`, in order of the levels."""
    levels = sorted(r[0] for r in df.select(F.col(by).cast("string")).dropna().distinct().collect())  # treatments or zones of one plan
    fills = ofe_palette(palette, max(len(levels), 1))
    table = df.sparkSession.createDataFrame([(v, f, ink_on(f)) for v, f in zip(levels, fills, strict=False)], "_level string, fill string, ink string")
    return df.join(F.broadcast(table), F.col(by).cast("string") == F.col("_level"), "left").drop("_level")


def _extent(half: float) -> list:
    return [(F.min("x") - half).alias("x0"), (F.max("x") + half).alias("x1"), (F.min("y") - half).alias("y0"), (F.max("y") + half).alias("y1")]


BOX = ("x0", "x1", "y0", "y1")


def draw_design(design: DataFrame) -> DataFrame:
    """The plan of a design: its plots with their treatments, and a border round each replicate of a tier."""
    require_columns(design, "x", "y", "treat", "rep", "plot", "tier")
    half = spacing(design, "x", "y") / 2
    box = tuple(F.col(c) for c in BOX)
    own = design.filter("plot is not null")
    plots = _coloured(own.groupBy("plot", "tier", "treat").agg(*_extent(half)), "treat", "treatment")
    reps = own.groupBy("rep", "tier").agg(*_extent(half))
    return _marks(plots, "plot", box, F.col("treat"), F.col("fill"), F.col("ink")).unionByName(_marks(reps, "replicate", box, F.col("rep"), None, None))


def draw_zones(cells: DataFrame, zone: str = "zone") -> DataFrame:
    """A map of zones, light to dark, with the number of each at the median place of its cells."""
    require_columns(cells, zone)
    x, y = places_of(cells)
    half = spacing(cells, x, y) / 2
    own = cells.select(number(x).alias("x"), number(y).alias("y"), F.format_string("%06d", F.col(zone).cast("int")).alias("_key"), F.col(zone).cast("string").alias("_zone")).filter("_zone is not null")
    filled = _coloured(own, "_key", "zone")
    at = filled.groupBy("_zone", "fill", "ink").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    here = (F.col("x"), F.col("x"), F.col("y"), F.col("y"))
    return _marks(filled, "cell", (F.col("x") - half, F.col("x") + half, F.col("y") - half, F.col("y") + half), F.col("_zone"), F.col("fill"), None).unionByName(_marks(at, "label", here, F.col("_zone"), F.col("fill"), F.col("ink")))


def draw_stations(stations: DataFrame, design: DataFrame) -> DataFrame:
    """The sampling map: plots, and a mark at each quadrat."""
    require_columns(stations, "x", "y", "station", "quadrat")
    here = (F.col("x"), F.col("x"), F.col("y"), F.col("y"))
    return draw_design(design).filter("kind = 'plot'").unionByName(_marks(stations, "quadrat", here, F.concat_ws(".", "station", "quadrat"), None, None))
