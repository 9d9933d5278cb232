"""Empirical variograms, their fits, and what follows from a fitted one in closed form."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators.clean import field_hull
from tilth.semantics import number, require_columns, right_closed_bin

MODELS = ("Exp", "Sph", "Gau")
PRACTICAL = {"Exp": 3.0, "Sph": 1.0, "Gau": math.sqrt(3.0)}
#: Squares along a cutoff that is a third of the field, so that the pairs are shared out over some eighty squares, not nine. Fixed.
FINE = 3


def pair_bins(points: DataFrame, value: str, x: str = "x", y: str = "y", cutoff: float = 1.0, n_bin: int = 15, fine: int = 1) -> DataFrame:
    """bin, h, gamma, n_pair over pairs no further apart than cutoff, in right-closed bins.

    Rows of one place count as one: all their pairs with those of another place have the same
    distance, and their squared differences add up to what the counts, means and spreads of the two
    say. So the work grows with the pairs of places, whatever number of rows a place has. Places meet
    by equi-join on squares, `fine` of them along the cutoff: a place goes to its own square and to
    those within reach that come later (four of the eight around it where fine is 1), so no two meet
    twice. Few places make many pairs, so the join keeps the session's number of partitions, however
    small they are.
    """
    require_columns(points, value, x, y)
    own = points.select(number(x).alias("x"), number(y).alias("y"), number(value).alias("v")).dropna()
    endless = F.when(F.abs("v") == float("inf"), F.col("v")).otherwise(F.lit(0.0))  # apart from the others of a place, for they have no spread
    own = own.groupBy("x", "y", endless.alias("w")).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.nanvl(F.var_pop("v") * F.count("*"), F.lit(0.0)).alias("s")).withColumn("id", F.struct("x", "y", "w"))
    side, parts = cutoff / fine * (1 + 1e-9), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(fine + 1) for j in range(-fine, fine + 1) if (i, j) >= (0, 0)])
    later = own.select(*[F.col(c).alias(f"{c}2") for c in ("id", "x", "y", "n", "m", "s")], "cx", "cy", F.explode(steps).alias("t"))
    later = later.select("id2", "x2", "y2", "n2", "m2", "s2", (F.col("cx") - F.col("t.i")).alias("cx"), (F.col("cy") - F.col("t.j")).alias("cy"), ((F.col("t.i") == 0) & (F.col("t.j") == 0)).alias("same"))
    h = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    k = F.col("n") * F.col("n2")
    g = (F.col("n") * F.col("s2") + F.col("n2") * F.col("s") + k * F.pow(F.col("m") - F.col("m2"), 2)) / 2
    pairs = own.repartition(parts, "cx", "cy").join(later.repartition(parts, "cx", "cy"), ["cx", "cy"]).filter(~F.col("same") | (F.col("id") < F.col("id2"))).select(h.alias("h"), g.alias("g"), k.alias("k")).filter((F.col("h") <= cutoff) & (F.col("h") > 0))
    n_pair = F.sum("k")
    return pairs.groupBy(F.least(right_closed_bin(F.col("h"), cutoff / n_bin), F.lit(n_bin)).alias("bin")).agg((F.sum(F.col("h") * F.col("k")) / n_pair).alias("h"), (F.sum("g") / n_pair).alias("gamma"), n_pair.alias("n_pair")).filter("n_pair >= 2")


def shape(model: str, h, a: float):
    """The rise from 0 to 1 of a model at distance h > 0."""
    r = np.asarray(h, float) / a
    if model == "Exp":
        return 1 - np.exp(-r)
    if model == "Gau":
        return 1 - np.exp(-(r**2))
    return np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0)


@dataclass(frozen=True)
class Variogram:
    """nugget + psill * shape(h / a); practical is the distance at which it has risen."""

    model: str
    nugget: float
    psill: float
    a: float
    sse: float = math.nan

    @property
    def practical(self) -> float:
        return PRACTICAL[self.model] * self.a

    def gamma(self, h):
        h = np.asarray(h, float)
        return np.where(h > 0, self.nugget + self.psill * shape(self.model, h, self.a), 0.0)


def fit_variogram(h, gamma, n_pair, models=MODELS, steps: int = 200) -> Variogram:
    """The model, range, nugget and sill of least weighted squares, the last two not negative.

    For each range of a log grid the best nugget and sill have a closed form; where one would be
    negative it is held at zero.
    """
    h, gamma, w = (np.asarray(v, float) for v in (h, gamma, n_pair))
    w = w / w.sum()
    best = None
    for model in models:
        for a in np.geomspace(0.25 * h.min(), 3 * h.max(), steps):
            s = shape(model, h, a)
            tries = []
            ms, mg = (w * s).sum(), (w * gamma).sum()
            var = (w * (s - ms) ** 2).sum()
            if var > 1e-14:
                p = (w * (s - ms) * (gamma - mg)).sum() / var
                tries.append((mg - p * ms, p))
            tries += [(0.0, (w * s * gamma).sum() / max((w * s * s).sum(), 1e-300)), (mg, 0.0)]
            for c0, p in tries:
                if c0 >= 0 and p >= 0:
                    sse = (w * (gamma - c0 - p * s) ** 2).sum()
                    if best is None or sse < best.sse:
                        best = Variogram(model, float(c0), float(p), float(a), float(sse))
                    break
    return best


def detrended(points: DataFrame, value: str, trend: list[str]) -> DataFrame:
    """points with value replaced by the residual of a linear fit on the columns in trend, from one row of sums."""
    cols = [F.lit(1.0), *(number(t) for t in trend)]
    k = len(cols)
    ready = points.select("*", *[c.alias(f"_z{i}") for i, c in enumerate(cols)], number(value).alias("_v")).dropna(subset=[*(f"_z{i}" for i in range(k)), "_v"])
    sums = ready.agg(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(F.col(f"_z{i}") * F.col("_v")).alias(f"b{i}") for i in range(k)]).first()
    beta = np.linalg.lstsq(np.array([[sums[f"a{i}_{j}"] for j in range(k)] for i in range(k)]), np.array([sums[f"b{i}"] for i in range(k)]), rcond=None)[0]
    fit = sum((F.col(f"_z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    return ready.withColumn(value, F.col("_v") - fit).drop("_v", *(f"_z{i}" for i in range(k)))


#: The fewest samples and pairs that a variogram is fitted to. Fixed values.
LEAST_SAMPLES, LEAST_PAIRS = 10, 30


def longest_distance(points: DataFrame, x: str = "x", y: str = "y") -> float:
    """The largest distance between two points: it lies between two corners of their hull."""
    corners = field_hull(points.select(number(x).alias("x"), number(y).alias("y")).distinct())
    return max((float(np.hypot(*(corners - c).T).max()) for c in corners), default=0.0)


def ofe_variogram(points: DataFrame, value: str, x: str = "x", y: str = "y", trend: list[str] | None = None, n_bin: int = 15, cutoff: float | None = None, model: str | None = None) -> tuple[DataFrame, Variogram]:
    """The empirical bins and the best fit. The cutoff is a third of the longest distance unless given. ValueError under ten samples or thirty pairs."""
    require_columns(points, value, x, y, *(trend or []))
    if model is not None and model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    own = points.filter(number(x).isNotNull() & number(y).isNotNull() & number(value).isNotNull())
    own = detrended(own, value, trend) if trend else own
    n = own.count()
    if n < LEAST_SAMPLES:
        raise ValueError(f"{n} samples are too few for a variogram")
    if cutoff is None:
        cutoff = longest_distance(own, x, y) / 3
    if not cutoff > 0:
        raise ValueError("all samples are in one place")
    bins = pair_bins(own, value, x, y, cutoff, n_bin, FINE)
    rows = bins.orderBy("bin").collect()  # n_bin rows at most
    bins = points.sparkSession.createDataFrame(rows, bins.schema)  # so that no reader of them meets the pairs again
    if sum(r["n_pair"] for r in rows) < LEAST_PAIRS:
        raise ValueError("too few pairs of samples lie within the cutoff")
    if len(rows) < 3:
        raise ValueError("fewer than three usable bins")
    return bins, fit_variogram([r["h"] for r in rows], [r["gamma"] for r in rows], [r["n_pair"] for r in rows], (model,) if model else MODELS)


def identified(v: Variogram, bins: DataFrame) -> bool:
    """Whether the practical range lies within the distances that were seen."""
    return v.practical <= (bins.agg(F.max("h")).first()[0] or 0.0)


def kriging_sample_interval(spark: SparkSession, nugget: float, psill: float, practical_range: float, model: str = "Exp", target_kse: float = 0.5, area_ha: float | None = None, n: int = 60) -> DataFrame:
    """interval, variance, rel_kse, floor, n_samples, chosen over n intervals from a twentieth of the range to twice it.

    The middle of a square of four samples has equal weights by symmetry, so its kriging variance is
    2 g(d / sqrt 2) - (8 g(d) + 4 g(d sqrt 2)) / 16. The largest interval at target_kse or less is chosen.
    """
    if target_kse <= 0:
        raise ValueError("target_kse must be positive")
    a = practical_range / PRACTICAL[model]
    d = F.lit(practical_range / 20) + F.col("id") * (practical_range * 2 - practical_range / 20) / (n - 1)

    def g(h):
        r = h / a
        rise = 1 - F.exp(-r) if model == "Exp" else 1 - F.exp(-r * r) if model == "Gau" else F.when(r < 1, 1.5 * r - 0.5 * r * r * r).otherwise(1.0)
        return F.lit(nugget) + psill * rise

    v = 2 * g(d / math.sqrt(2)) - (8 * g(d) + 4 * g(d * math.sqrt(2))) / 16
    rel = F.sqrt(v) / math.sqrt(nugget + psill)
    out = spark.range(n).select(d.alias("interval"), v.alias("variance"), rel.alias("rel_kse"), F.lit(math.sqrt(nugget / (nugget + psill))).alias("floor"))
    out = out.withColumn("n_samples", F.ceil(F.lit(area_ha * 10000.0) / (F.col("interval") * F.col("interval"))) if area_ha else F.lit(None).cast("long"))
    best = out.filter(F.col("rel_kse") <= target_kse).agg(F.max("interval").alias("best"))
    return out.join(F.broadcast(best)).withColumn("chosen", F.coalesce(F.col("interval") == F.col("best"), F.lit(False))).drop("best")
