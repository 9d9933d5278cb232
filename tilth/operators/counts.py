"""Strip counts: sums by strip, the strip analysis, and the precision of a counting plan."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions.distributions import f_tail, t_quantile
from tilth.semantics import number, require_columns


def strip_summary(data: DataFrame, count: str, strip: str, treat: str, block: str | None = None, area: str | None = None, baseline: str | None = None) -> DataFrame:
    """strip, treat, block, quadrats, count, area, density, baseline, response (log density, or log of after over before; half a count is added)."""
    require_columns(data, count, strip, treat, block, area, baseline)
    if (area is None) == (baseline is None):
        raise ValueError("give an area or a baseline")
    other = number(area or baseline)
    ready = data.filter(number(count).isNotNull() & other.isNotNull())
    g = ready.groupBy(F.col(strip).alias("strip")).agg(F.min(F.col(treat).cast("string")).alias("treat"), F.max(F.col(treat).cast("string")).alias("_last"), F.min(F.col(block)).alias("block") if block else F.lit(None).cast("string").alias("block"), F.count("*").alias("quadrats"), F.sum(number(count)).alias("count"), F.sum(other).alias("_other"))
    g = g.withColumn("treat", F.when(F.col("treat") == F.col("_last"), F.col("treat")).otherwise(F.raise_error(F.lit("a strip has more than one treatment"))))
    area_, base = (F.col("_other"), F.lit(None).cast("double")) if area else (F.lit(None).cast("double"), F.col("_other"))
    response = F.ln((F.col("count") + 0.5) / (F.col("_other") if area else F.col("_other") + 0.5))
    return g.select("strip", "treat", "block", "quadrats", "count", area_.alias("area"), F.expr("try_divide(`count`, `_other`)").alias("density") if area else F.lit(None).cast("double").alias("density"), base.alias("baseline"), response.alias("response"))


def analyse_strip_counts(data: DataFrame, count: str, strip: str, treat: str, block: str | None = None, area: str | None = None, baseline: str | None = None, level: float = 0.95) -> dict:
    """The F test of treatments and the ratio of each to the first with its interval, from least squares on the strips."""
    s = strip_summary(data, count, strip, treat, block, area, baseline).toPandas().sort_values("strip")  # one row a strip
    levels = sorted(s["treat"].unique())
    if len(levels) < 2:
        raise ValueError("at least two treatments are needed")
    dummies = lambda c: pd.get_dummies(s[c].astype(str)).iloc[:, 1:].to_numpy(float)
    base = np.column_stack([np.ones(len(s)), dummies("block")] if block else [np.ones(len(s))])
    t = np.column_stack([(s["treat"] == v).to_numpy(float) for v in levels[1:]])
    y = s["response"].to_numpy(float)

    def fit(x):
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        return beta, ((y - x @ beta) ** 2).sum(), rank

    _, rss0, r0 = fit(base)
    x = np.column_stack([base, t])
    beta, rss, rank = fit(x)
    df = len(y) - rank
    if df < 1:
        raise ValueError("no degrees of freedom are left")
    s2 = rss / df
    cov = s2 * np.linalg.pinv(x.T @ x)
    f = (rss0 - rss) / (rank - r0) / s2
    q = t_quantile(0.5 + level / 2, df)
    ratios = [(v, float(np.exp(b)), float(np.exp(b - q * e)), float(np.exp(b + q * e))) for v, b, e in zip(levels[1:], beta[base.shape[1] :], np.sqrt(np.diag(cov))[base.shape[1] :], strict=True)]
    return {"f": float(f), "df": (int(rank - r0), int(df)), "p": float(f_tail(f, rank - r0, df)), "reference": levels[0], "ratios": ratios}


# The published presets. Densities per square metre, variances on the log scale, ranges in metres.
CROPS = {
    "wheat": {"mean_density": 120.0, "var_cell": 0.015, "patch_range": 20.0, "var_trend": 0.01, "trend_range": 200.0},
    "barley": {"mean_density": 120.0, "var_cell": 0.015, "patch_range": 20.0, "var_trend": 0.01, "trend_range": 200.0},
    "canola": {"mean_density": 40.0, "var_cell": 0.02, "patch_range": 20.0, "var_trend": 0.02, "trend_range": 200.0},
    "weeds": {"mean_density": 10.0, "var_cell": 0.6, "var_patch": 0.6, "patch_range": 20.0, "var_trend": 0.6, "trend_range": 400.0},
    "custom": {},
}
PATCHES = {"wheat": {"low": 0.003, "central": 0.03, "high": 0.087}, "barley": {"low": 0.003, "central": 0.03, "high": 0.087}, "canola": {"low": 0.0, "central": 0.04, "high": 0.087}}
#: The practical range of the field, where correlation is 0.05, in units of the kernel's scale. Fixed value.
PRACTICAL = 5.4
CELL, COARSE = 0.5, 4
MODEL = ("mean_density", "var_cell", "var_patch", "patch_range", "var_trend", "trend_range")


def count_preset(crop: str = "wheat", patchiness: str = "central", **given: float | None) -> dict[str, float]:
    """The model of a crop; what is given overrides it. ValueError if 'custom' leaves a value open."""
    if crop not in CROPS:
        raise ValueError(f"unknown crop: {crop}")
    out = CROPS[crop] | ({"var_patch": PATCHES[crop][patchiness]} if crop in PATCHES else {})
    out |= {k: float(v) for k, v in given.items() if v is not None}
    if missing := [k for k in MODEL if k not in out]:
        raise ValueError(f"a custom crop needs {', '.join(missing)}")
    return {k: out[k] for k in MODEL}


def _smooth_size(n: int) -> int:
    """The next size from n on whose transform is fast: no prime factor above 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


class _Field:
    """Draws of white noise through an exponential kernel, padded so that the far sides don't meet; unit variance."""

    def __init__(self, rows: int, cols: int, practical: float, step: float):
        scale = max(practical / PRACTICAL / step, 1e-6)
        self.rows, self.cols = rows, cols
        self.shape = tuple(_smooth_size(n + 2 * math.ceil(4 * scale)) for n in (rows, cols))
        at = [np.minimum(np.arange(n), n - np.arange(n)) for n in self.shape]
        kernel = np.exp(-np.hypot(at[0][:, None], at[1][None]) / scale)
        self.kernel = np.fft.rfft2(kernel / np.sqrt((kernel**2).sum()))

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        return np.fft.irfft2(np.fft.rfft2(rng.normal(size=self.shape)) * self.kernel, s=self.shape)[: self.rows, : self.cols]


def simulate_counts(spark: SparkSession, n_stations: list[int], n_quadrats: int = 2, quadrat_area: float = 0.25, model: dict[str, float] | None = None, strip_length: float = 250.0, strip_width: float = 12.0, end_buffer: float = 20.0, side_buffer: float = 2.0, quadrat_spread: float = 2.5, n_sim: int = 400, seed: int = 1) -> DataFrame:
    """sim, n_stations, error: the relative error of a strip's estimated density in each simulated strip, which all plans share.

    Log density is the sum of a value for each half-metre cell, patches, and a trend drawn on a grid
    four times as wide. Stations stand at equal steps between the end buffers from a random start;
    quadrats of a station are spread along by up to quadrat_spread and lie anywhere between the side
    buffers. A quadrat covers whole cells, two wide from three cells on. Counts are Poisson.
    """
    model = model or count_preset()
    stations = sorted({int(n) for n in n_stations})
    if not stations or stations[0] < 1 or n_quadrats < 1 or quadrat_area <= 0:
        raise ValueError("stations, quadrats and their area must be positive")
    if strip_length <= 2 * end_buffer or strip_width <= 2 * side_buffer:
        raise ValueError("the buffers leave no room in the strip")
    rows, cols = round(strip_length / CELL), round(strip_width / CELL)
    covered = max(1, round(quadrat_area / CELL**2))
    wide = 1 if covered <= 2 else 2
    deep = math.ceil(covered / wide)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patches, trend = _Field(rows, cols, model["patch_range"], CELL), _Field(-(-rows // COARSE), -(-cols // COARSE), model["trend_range"], CELL * COARSE)
        middle = math.log(model["mean_density"]) - (model["var_cell"] + model["var_patch"] + model["var_trend"]) / 2
        for b in batches:
            out = []
            for sim in b["id"]:
                rng = np.random.default_rng((seed, int(sim)))
                eta = middle + math.sqrt(model["var_cell"]) * rng.normal(size=(rows, cols)) + math.sqrt(model["var_patch"]) * patches.draw(rng)
                eta += math.sqrt(model["var_trend"]) * np.kron(trend.draw(rng), np.ones((COARSE, COARSE)))[:rows, :cols]
                density = np.exp(eta)
                inside = np.pad(density, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1) * CELL**2  # plants above and left of each corner
                for n in stations:
                    along = np.repeat(end_buffer + (np.arange(n) + rng.random()) * (strip_length - 2 * end_buffer) / n, n_quadrats)
                    if n_quadrats > 1:
                        along = along + rng.uniform(-quadrat_spread, quadrat_spread, len(along))
                    r = (np.clip(along, 0, strip_length - deep * CELL) / CELL).astype(int)
                    c = (rng.uniform(side_buffer, max(strip_width - side_buffer - wide * CELL, side_buffer), len(along)) / CELL).astype(int)
                    expected = inside[r + deep, c + wide] - inside[r, c + wide] - inside[r + deep, c] + inside[r, c]
                    found = rng.poisson(np.maximum(expected, 0)).sum() / (len(along) * deep * wide * CELL**2)
                    out.append((sim, n, found / density.mean() - 1))
            yield pd.DataFrame(out, columns=["sim", "n_stations", "error"])

    return spark.range(0, n_sim, 1, max(1, min(n_sim, spark.sparkContext.defaultParallelism))).mapInPandas(work, "sim long, n_stations int, error double")


def count_precision(spark: SparkSession, n_stations: list[int] = (5, 8, 12, 20), n_quadrats: int = 2, quadrat_area: float = 0.25, crop: str = "wheat", patchiness: str = "central", strip_length: float = 250.0, strip_width: float = 12.0, end_buffer: float = 20.0, side_buffer: float = 2.0, n_sim: int = 400, seed: int = 1, **model: float | None) -> DataFrame:
    """n_stations, n_quadrats, quadrat_area (as covered), counts, margin95, rmse, bias of a strip's estimated density.

    model: any of MODEL, overriding the crop's preset; all of them for the crop 'custom'.
    """
    sims = simulate_counts(spark, list(n_stations), n_quadrats, quadrat_area, count_preset(crop, patchiness, **model), strip_length, strip_width, end_buffer, side_buffer, n_sim=n_sim, seed=seed)
    covered = max(1, round(quadrat_area / CELL**2))
    wide = 1 if covered <= 2 else 2
    figures = sims.groupBy("n_stations").agg(F.percentile(F.abs("error"), F.lit(0.95)).alias("margin95"), F.sqrt(F.avg(F.pow("error", F.lit(2)))).alias("rmse"), F.avg("error").alias("bias"))
    return figures.select("n_stations", F.lit(n_quadrats).alias("n_quadrats"), F.lit(math.ceil(covered / wide) * wide * CELL**2).alias("quadrat_area"), (F.col("n_stations") * n_quadrats).alias("counts"), "margin95", "rmse", "bias")


def count_sample_size(spark: SparkSession, target: float, max_stations: int = 40, **plan) -> DataFrame:
    """The row of count_precision with the fewest stations, from 2 on, whose margin95 is target or less; that of max_stations with null stations if none is."""
    if not 0 < target < math.inf:
        raise ValueError("target must be positive")
    table = count_precision(spark, list(range(2, max_stations + 1)), **plan)
    fits = F.col("margin95") <= target
    first = table.orderBy(F.when(fits, F.col("n_stations")).otherwise(2 * max_stations - F.col("n_stations"))).limit(1)
    return first.withColumn("n_stations", F.when(fits, F.col("n_stations")))
