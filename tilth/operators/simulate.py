"""Simulated trials, paddocks and harvester clouds: one task row a seed, each seed its own generator."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilth.semantics import keyed_uniform

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def surface(rng: np.random.Generator, rows: int, cols: int, practical: float, step: float = 1.0) -> np.ndarray:
    """A Gaussian field with an exponential covariance, by circulant embedding on a torus of twice the size; unit variance."""
    r, c = 2 * rows, 2 * cols
    i, j = np.minimum(np.arange(r), r - np.arange(r)), np.minimum(np.arange(c), c - np.arange(c))
    power = np.maximum(np.fft.fft2(np.exp(-3 * step * np.hypot(i[:, None], j[None]) / practical)).real, 0)
    noise = rng.normal(size=(r, c)) + 1j * rng.normal(size=(r, c))
    return np.fft.fft2(np.sqrt(power / (r * c)) * noise).real[:rows, :cols]


def _point_surface(rng: np.random.Generator, rows: int, cols: int, a: float, psill: float, nugget: float, step: float = 1.0) -> np.ndarray:
    """A surface of an exponential variogram with range parameter a (a third of the practical one), and its nugget."""
    return math.sqrt(psill) * surface(rng, rows, cols, 3 * a, step) + math.sqrt(nugget) * rng.normal(size=(rows, cols))


def _standard(v: np.ndarray) -> np.ndarray:
    return (v - v.mean()) / v.std(ddof=1)


def _per_seed(spark: SparkSession, seeds: list[int], schema: str, make: Callable[[np.random.Generator], pd.DataFrame]) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["seed"]:
                out = make(np.random.default_rng(int(s)))
                out.insert(0, "seed", int(s))
                yield out

    return spark.createDataFrame([(int(s),) for s in seeds], "seed long").repartition(max(1, min(len(seeds), 1000))).mapInPandas(work, f"seed long, {schema}")


def simulate_ofe_trial(
    spark: SparkSession, seeds: list[int], n_row: int = 40, n_col: int = 20, treat_effects: tuple[float, ...] = (0.0, 0.8, 1.6), point_range: float = 8.0, point_psill: float = 1.2, point_nugget: float = 0.1,
    dense_var_weight: float = 0.6, noise_sd: float = 0.4, n_point_samples: int = 10, point_obs_noise_sd: float = 0.3,
) -> DataFrame:
    """seed, row, col, treat, point_true, dense_response, point_obs (at n_point_samples cells): strips of columns over a random field.

    Treatments are letters in order of their effects, in equal bands of columns.
    """

    def make(rng):
        r, c = (v.ravel() for v in np.mgrid[1 : n_row + 1, 1 : n_col + 1])
        k = np.ceil(c * len(treat_effects) / n_col - 1e-9).astype(int) - 1
        point = _point_surface(rng, n_row, n_col, point_range, point_psill, point_nugget).ravel()
        y = np.array(treat_effects)[k] + dense_var_weight * point + noise_sd * rng.normal(size=point.size)
        seen = np.full(point.size, np.nan)
        at = rng.choice(point.size, min(n_point_samples, point.size), replace=False)
        seen[at] = point[at] + point_obs_noise_sd * rng.normal(size=len(at))
        return pd.DataFrame({"row": r, "col": c, "treat": np.array(list(LETTERS))[k], "point_true": point, "dense_response": y, "point_obs": pd.array(seen, "Float64")})

    return _per_seed(spark, seeds, "row int, col int, treat string, point_true double, dense_response double, point_obs double", make).withColumn("point_obs", F.nanvl("point_obs", F.lit(None)))


@dataclass(frozen=True)
class Layer:
    """A covariate: its mean, spread, practical range (the paddock's unless given) and correlation with the yield potential (the paddock's unless given)."""

    mean: float = 0.0
    sd: float = 1.0
    range: float | None = None
    cor: float | None = None


def simulate_paddock(
    spark: SparkSession, seeds: list[int], n_row: int = 40, n_col: int = 24, cell_size: float = 10.0, yield_mean: float = 3.0, yield_range: float = 80.0, yield_sd: float = 0.6, covariates: dict[str, Layer] | None = None,
    covariate_cor: float = 0.6, n_zones: int = 1, zone_props: list[float] | None = None, treatments: list[str] | None = None, n_rep: int = 4, treat_effect: list[float] | None = None, zone_effect: list[float] | None = None,
    noise_sd: float = 0.3, randomise: bool = True,
) -> DataFrame:
    """seed, row, col, x, y, yield_potential, covariates, zone and, with treatments, treat, rep, plot and yield.

    Zones are bands along y. A trial of randomised strips is laid over the paddock and joined to its
    cells; cells beyond the last strip have none, and no yield. yield is the potential, the
    treatment's effect times its zone's multiplier, and noise.
    """
    layers = covariates if covariates is not None else {"elevation": Layer(100.0, 3.0, yield_range * 1.5), "clay": Layer(30.0, 6.0, yield_range * 0.8)}
    cor = {name: covariate_cor if s.cor is None else s.cor for name, s in layers.items()}
    if any(abs(c) > 1 for c in cor.values()):
        raise ValueError("a correlation must lie between -1 and 1")
    props = np.array(zone_props if zone_props is not None else [1 / n_zones] * n_zones, float)
    if len(props) != n_zones:
        raise ValueError("zone_props must have one number for each zone")
    ends = np.cumsum(props / props.sum()) * n_row * cell_size

    def make(rng):
        r, c = (v.ravel() for v in np.mgrid[1 : n_row + 1, 1 : n_col + 1])
        pot = _standard(surface(rng, n_row, n_col, yield_range, cell_size).ravel())
        out = {"row": r, "col": c, "x": c * cell_size, "y": r * cell_size, "yield_potential": yield_mean + yield_sd * pot}
        for name, s in layers.items():
            own = _standard(surface(rng, n_row, n_col, s.range or yield_range, cell_size).ravel())
            out[name] = s.mean + s.sd * _standard(cor[name] * pot + math.sqrt(1 - cor[name] ** 2) * own)
        out["zone"] = np.minimum(np.searchsorted(ends + 1e-9, out["y"], side="left"), n_zones - 1) + 1
        out["noise"] = noise_sd * rng.normal(size=r.size)
        return pd.DataFrame(out)

    schema = "row int, col int, x double, y double, yield_potential double, " + "".join(f"`{k}` double, " for k in layers) + "zone int, noise double"
    cells = _per_seed(spark, seeds, schema, make)
    if treatments is None:
        return cells.drop("noise")
    n_t = len(treatments)
    effects = treat_effect if treat_effect is not None else np.linspace(0, 0.8, n_t).tolist()
    times = zone_effect if zone_effect is not None else [1.0] * n_zones
    if len(effects) != n_t or len(times) != n_zones:
        raise ValueError("effects must have one number for each treatment, or for each zone")
    wide = n_col // (n_t * n_rep)  # columns of a plot
    if not wide:
        raise ValueError(f"{n_col} columns are too few for {n_t} treatments in {n_rep} replicates")
    names = spark.createDataFrame([(i, t, float(e)) for i, (t, e) in enumerate(zip(treatments, effects, strict=True))], "place int, treat string, effect double")
    multiplier = spark.createDataFrame([(i + 1, float(m)) for i, m in enumerate(times)], "zone int, multiplier double")
    book = spark.createDataFrame([(int(s),) for s in seeds], "seed long").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_rep)))).join(F.broadcast(names))
    key = keyed_uniform(F.col("seed"), F.col("rep"), F.col("treat")) if randomise else F.col("place").cast("double")
    book = book.withColumn("plot", ((F.col("rep") - 1) * n_t + F.row_number().over(Window.partitionBy("seed", "rep").orderBy(key, "place"))).cast("int")).drop("place")
    placed = cells.withColumn("plot", (F.floor((F.col("col") - 1) / wide) + 1).cast("int")).join(book, ["seed", "plot"], "left").join(F.broadcast(multiplier), "zone")
    return placed.select("seed", "row", "col", "x", "y", "yield_potential", *layers, "zone", "treat", "rep", F.when(F.col("treat").isNotNull(), F.col("plot")).alias("plot"), (F.col("yield_potential") + F.col("effect") * F.col("multiplier") + F.col("noise")).alias("yield"))


def paddock_truth(paddock: DataFrame, covariates: list[str]) -> DataFrame:
    """By seed: the correlation of each covariate with the yield potential, and the potential's variance."""
    return paddock.groupBy("seed").agg(*[F.corr(c, "yield_potential").alias(f"cor_{c}") for c in covariates], F.var_samp("yield_potential").alias("var_potential"))


@dataclass(frozen=True)
class Defects:
    """What goes wrong at harvest: ramps at the ends of passes, slow stretches, dropouts and spikes. Distances in metres."""

    ramp_m: float = 12.0
    ramp_low: float = 0.55
    ramp_high: float = 1.35
    slow_m: float = 8.0
    slow_factor: float = 0.45
    outlier_prob: float = 0.02
    spike_factor: float = 4.0


@dataclass(frozen=True)
class Harvest:
    """How simulate_yield_monitor's field lies and is driven."""

    field_x: float = 240.0
    field_y: float = 108.0
    swath: float = 9.0
    along_spacing: float = 1.5
    band_swaths: int = 2
    treat_effects: tuple[float, ...] = (0.0, 0.8, 1.6)
    point_range: float = 25.0
    point_psill: float = 1.2
    point_nugget: float = 0.1
    dense_var_weight: float = 0.6
    noise_sd: float = 0.4
    gps_jitter: float = 0.5
    skip_pass_prob: float = 0.08
    cut_corner: bool = True
    truth_res: float = 3.0
    defects: Defects | None = None

    def drive(self, rng: np.random.Generator) -> pd.DataFrame:
        """The cloud in recording order: to and fro along x, some passes missing, a corner cut off."""
        truth = _point_surface(rng, max(1, int(self.field_y // self.truth_res)), max(1, int(self.field_x // self.truth_res)), self.point_range, self.point_psill, self.point_nugget, self.truth_res)
        lines = np.arange(self.swath / 2, self.field_y + 1e-9, self.swath)
        lines = lines[rng.random(len(lines)) > self.skip_pass_prob]
        if not len(lines):
            raise ValueError("every pass was skipped; lower skip_pass_prob")
        along = np.arange(0, self.field_x + 1e-9, self.along_spacing)
        number = np.repeat(np.arange(len(lines)) + 1, len(along))
        x = np.concatenate([along[:: 1 if i % 2 == 0 else -1] for i in range(len(lines))])
        y = np.repeat(lines, len(along)) + self.gps_jitter * rng.normal(size=len(x))
        speed = 1.6 + 0.08 * rng.normal(size=len(x))
        keep = (y >= 0) & (y <= self.field_y)
        if self.cut_corner:  # the triangle beyond the line between four fifths of both sides
            keep &= np.maximum(x / self.field_x - 0.8, 0) + np.maximum(y / self.field_y - 0.8, 0) <= 0.2 + 1e-9
        number, x, y, speed = number[keep], x[keep], y[keep], speed[keep]
        band = np.floor(y / (self.swath * self.band_swaths)).astype(int)
        k = band % len(self.treat_effects)
        near = lambda v, n: np.clip(np.round(v / self.truth_res - 0.5).astype(int), 0, n - 1)
        point = truth[near(y, truth.shape[0]), near(x, truth.shape[1])]
        out = pd.DataFrame({"pass": number, "x": x, "y": y, "speed": speed, "treat": np.array(list(LETTERS))[k], "point_true": point, "band": band})
        out["yield"] = np.array(self.treat_effects)[k] + self.dense_var_weight * point + self.noise_sd * rng.normal(size=len(x))
        out["defect"] = None
        if self.defects:
            self._spoil(rng, out, self.defects)
        out["seq"] = np.arange(len(out)) + 1
        return out

    @staticmethod
    def _spoil(rng: np.random.Generator, out: pd.DataFrame, d: Defects) -> None:
        gone = (out["x"] - out.groupby("pass")["x"].transform("first")).abs()
        left = gone.groupby(out["pass"]).transform("max") - gone
        whole = out.groupby("pass")["x"].transform("size") >= 6
        for at, factor, name in ((whole & (gone <= d.ramp_m), d.ramp_low, "pass_start"), (whole & (left <= d.ramp_m), d.ramp_high, "pass_end")):
            out.loc[at, "yield"] *= factor
            out.loc[at, "defect"] = name
        out.loc[whole & ((gone <= d.slow_m) | (left <= d.slow_m)), "speed"] *= d.slow_factor
        hit = rng.permutation(len(out))[: round(d.outlier_prob * len(out))]
        half = round(len(hit) / 2)
        value = out["yield"].to_numpy(copy=True)
        value[hit[:half]] = 0.0
        value[hit[half:]] *= d.spike_factor
        out["yield"] = value
        out.loc[hit, "defect"] = "outlier"


CLOUD = "pass int, x double, y double, speed double, treat string, point_true double, yield double, defect string, seq int"


def simulate_yield_monitor(spark: SparkSession, seeds: list[int], harvest: Harvest = Harvest()) -> DataFrame:
    """seed, pass, x, y, speed, treat, point_true, yield, defect, seq of each seed's harvest."""
    return _per_seed(spark, seeds, CLOUD, lambda rng: harvest.drive(rng)[[c.split()[0] for c in CLOUD.split(", ")]])


def simulate_yield_samples(spark: SparkSession, seeds: list[int], harvest: Harvest = Harvest(), n: int = 30, design: str = "random", noise_sd: float = 0.3) -> DataFrame:
    """seed, x, y, point_true, point_obs: samples of the same seeds' point surface, anywhere in the cloud or at both ends of every strip."""
    if design not in ("random", "strip_ends"):
        raise ValueError(f"unknown design: {design}")

    def make(rng):
        cloud = harvest.drive(rng)
        if design == "random":
            at = rng.choice(len(cloud), min(n, len(cloud)), replace=False)
        else:
            each = max(1, round(n / (2 * cloud["band"].nunique())))
            at = []
            for _, own in cloud.groupby("band"):
                low, high = own["x"].quantile([0.1, 0.9])
                for end in (own.index[own["x"] <= low], own.index[own["x"] >= high]):
                    at += rng.choice(end, min(each, len(end)), replace=False).tolist()
            at = np.array(at[:n], int)
        own = cloud.iloc[at]
        return pd.DataFrame({"x": own["x"], "y": own["y"], "point_true": own["point_true"], "point_obs": own["point_true"] + noise_sd * rng.normal(size=len(own))})

    return _per_seed(spark, seeds, "x double, y double, point_true double, point_obs double", make)
