"""Per-trial numerics over a DataFrame of many trials: one task group a trial, one result row or more each."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.functions import reml, zoning
from tilth.operators.zones import STEPS
from tilth.semantics import require_columns

FIT = "term string, estimate double, std_error double, sigma2 double, loglik double, n long, n_dropped long, converged boolean, varcomp string, error string"
MEANS = "level string, by string, mean double, std_error double, lower double, upper double, letters string, lsd double"


def per_trial(data: DataFrame, trial: str, schema: str, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """work on each trial's rows; its result with the trial in front."""
    require_columns(data, trial)
    kind = data.schema[trial].dataType.simpleString()

    def one(g: pd.DataFrame) -> pd.DataFrame:
        out = work(g)
        out.insert(0, trial, g[trial].iloc[0])
        return out

    return data.groupBy(trial).applyInPandas(one, f"{trial} {kind}, {schema}")


def fit_trials(data: DataFrame, trial: str, fixed: str, random: str | None = None, residual: str = "~ ar1(row):ar1(col)", control: reml.Control = reml.Control()) -> DataFrame:
    """One row for each coefficient of each trial's fit; a trial that can't be fitted gives one row with the error."""
    names = [x.split()[0] for x in FIT.split(", ")]

    def work(g: pd.DataFrame) -> pd.DataFrame:
        try:
            f = reml.fit_ofe(g, fixed, random, residual, control)
        except (ValueError, np.linalg.LinAlgError) as e:
            return pd.DataFrame([(None,) * (len(names) - 1) + (str(e),)], columns=names)
        c = f.coefficients
        return c.assign(sigma2=f.sigma2, loglik=f.loglik, n=f.n, n_dropped=f.n_dropped, converged=f.converged, varcomp=json.dumps(f.varcomp), error=None)[names]

    return per_trial(data, trial, FIT, work)


def trial_means(data: DataFrame, trial: str, term: str, fixed: str, random: str | None = None, residual: str = "~ ar1(row):ar1(col)", by: str | None = None, alpha: float = 0.05, adjust: str = "none", control: reml.Control = reml.Control(se=False)) -> DataFrame:
    """Average marginal means of term with letters, for every trial."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        return reml.ofe_lsd(reml.fit_ofe(g, fixed, random, residual, control), term, by, alpha, adjust).rename(columns={term: "level"})[[x.split()[0] for x in MEANS.split(", ")]]

    return per_trial(data, trial, MEANS, work)


ZONES = "zone int, n long, area double, patches int, x_min double, x_max double, y_min double, y_max double"
CRITERIA = "k int, ssd double, r2 double, gain double, ch double, chosen boolean"


class _Paddock:
    """One trial's zones: of every row of g, those with a null covariate or place left without one."""

    def __init__(self, g: pd.DataFrame, covariates: list[str], method: str, neighbours: str, n_neighbours: int, n_pc: int | None, x: str, y: str, scale: bool, options: dict):
        g = g.sort_values(["row", "col"]).reset_index(drop=True)
        whole = g[[*covariates, x, y]].notna().all(axis=1)
        used = g[whole]
        if len(used) < 4:
            raise ValueError("fewer than four cells have all covariates")
        z = used[covariates].to_numpy(float)
        if scale:
            spread = z.std(axis=0, ddof=1)
            if not (spread > 0).any():
                raise ValueError("all covariates are constant")
            z = ((z - z.mean(axis=0)) / np.where(spread > 0, spread, 1))[:, spread > 0]
        if n_pc:
            z = zoning.principal(z, n_pc)
        row, col, self.xy = used["row"].to_numpy(), used["col"].to_numpy(), used[[x, y]].to_numpy(float)
        place = {rc: i for i, rc in enumerate(zip(row, col, strict=True))}
        if neighbours == "knn":
            edges = zoning.nearest_edges(self.xy, n_neighbours)
        else:
            edges = np.array([(i, place[r + a, c + b]) for (r, c), i in place.items() for a, b in STEPS[neighbours] if (r + a, c + b) in place], int).reshape(-1, 2)
        self.edges = zoning.connect(edges, self.xy)
        self.zone, self.table = zoning.partition(row, col, self.xy, z, self.edges, method, **options)
        self.used, self.all = used, g
        g["zone"] = pd.array([None] * len(g), "Int64")
        g.loc[whole, "zone"] = self.zone

    def summary(self, covariates: list[str], treat: str | None) -> pd.DataFrame:
        links = np.hypot(*(self.xy[self.edges[:, 0]] - self.xy[self.edges[:, 1]]).T)
        spacing = float(np.median(links[links > 0])) if (links > 0).any() else 1.0
        out = []
        for k in range(1, self.zone.max() + 1):
            at = np.nonzero(self.zone == k)[0]
            code = np.full(len(self.zone), -1)
            code[at] = np.arange(len(at))
            inner = code[self.edges[(code[self.edges] >= 0).all(axis=1)]]
            (x0, y0), (x1, y1) = self.xy[at].min(axis=0), self.xy[at].max(axis=0)
            row = [k, len(at), len(at) * spacing**2, int(zoning.components(len(at), inner).max()) + 1, x0, x1, y0, y1, *self.used[covariates].iloc[at].mean()]
            out.append([*row, self.used[treat].iloc[at].nunique()] if treat else row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in ZONES.split(", ")] + [f"mean_{c}" for c in covariates] + ["treatments"] * bool(treat))


def _paddocks(cells: DataFrame, trial: str, schema: str, make: Callable[[_Paddock], pd.DataFrame], covariates: list[str], method: str = "rectangle", neighbours: str = "rook", n_neighbours: int = 8, n_pc: int | None = None, x: str = "col", y: str = "row", scale: bool = True, more: tuple[str, ...] = (), **options) -> DataFrame:
    require_columns(cells, trial, "row", "col", x, y, *covariates, *more)
    if not covariates or len(set(covariates)) < len(covariates):
        raise ValueError("covariates must name columns, each once")
    if neighbours != "knn" and neighbours not in STEPS:
        raise ValueError(f"unknown neighbours: {neighbours}")
    own = cells.select(*dict.fromkeys([trial, "row", "col", x, y, *covariates, *more]))
    return per_trial(own, trial, schema, lambda g: make(_Paddock(g, covariates, method, neighbours, n_neighbours, n_pc, x, y, scale, options)))


def partition_paddock(cells: DataFrame, trial: str, covariates: list[str], method: str = "rectangle", **options) -> DataFrame:
    """row, col, zone of each trial's cells by standardised covariates; constant ones are left out. Cells that lack a covariate have a null zone.

    Options: neighbours 'rook', 'queen', or 'knn' for the n_neighbours nearest by x and y; n_pc to
    follow that many principal components; scale=False for covariates as they are; and those of
    zoning.partition (k, k_max, criterion, min_gain, min_cells, min_r2).
    """
    return _paddocks(cells, trial, "row int, col int, zone int", lambda p: p.all[["row", "col", "zone"]], covariates, method, **options)


def paddock_zones(cells: DataFrame, trial: str, covariates: list[str], method: str = "rectangle", treat: str | None = None, **options) -> DataFrame:
    """A row for each zone of partition_paddock: cells, area, connected patches, corners, means of the covariates and, with treat, how many treatments it has."""
    schema = ZONES + "".join(f", mean_{c} double" for c in covariates) + ", treatments long" * bool(treat)
    return _paddocks(cells, trial, schema, lambda p: p.summary(covariates, treat), covariates, method, more=(treat,) if treat else (), **options)


def paddock_criteria(cells: DataFrame, trial: str, covariates: list[str], method: str = "rectangle", **options) -> DataFrame:
    """The table that partition_paddock chooses the number of zones by."""

    def table(p: _Paddock) -> pd.DataFrame:
        t = pd.DataFrame(p.table, columns=["k", "ssd", "r2", "gain", "ch"])
        return t.assign(chosen=t["k"] == p.zone.max())

    return _paddocks(cells, trial, CRITERIA, table, covariates, method, **options)


def _residual(g: pd.DataFrame, response: str, factors: list[str]) -> np.ndarray:
    """The response less its least-squares fit on the factors' main effects."""
    x = np.hstack([np.ones((len(g), 1)), *(pd.get_dummies(g[f]).to_numpy(float) for f in factors)])
    y = g[response].to_numpy(float)
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


SEGMENTS = "zone int, start double, end double, width double, n long"
CHOICE = "n_zones int, sse double, bic double, chosen boolean, range double, min_width double"


class _Profile:
    """One trial's segments along a coordinate."""

    def __init__(self, g: pd.DataFrame, response: str, along: str, factors: list[str], n_zones: int | None, max_zones: int, min_width: float | None, method: str):
        p = g.assign(value=_residual(g, response, factors)).groupby(along)["value"].agg(["mean", "size"]).sort_index()
        self.at, mean, n = p.index.to_numpy(float), p["mean"].to_numpy(float), p["size"].to_numpy(float)
        m = len(self.at)
        if m < 2:
            raise ValueError(f"{along} has fewer than two positions")
        spacing = float(np.median(np.diff(self.at)))
        low, high = self.at[0] - spacing / 2, self.at[-1] + spacing / 2
        self.range = zoning.profile_range(mean, spacing, self.at[-1] - self.at[0] + spacing)
        self.width = max(self.range if min_width is None else min_width, spacing)
        self.size, self.table = p["size"], []
        if method == "equal":
            self.breaks = np.linspace(low, high, n_zones + 1)
            return
        least = max(1, int(np.ceil(self.width / spacing - 1e-9)))
        top = max(1, min(max_zones, m // least))
        found = zoning.segment_profile(mean, n, top, min(least, m))
        bic = zoning.segment_bic(found, m, int(n.sum()))
        if n_zones and n_zones > len(found):
            raise ValueError(f"{n_zones} zones can't be reached: at most {len(found)} are {self.width:g} wide or more")
        k = n_zones or int(np.argmin(bic)) + 1
        self.table = [(i + 1, sse / n.sum() * m, b, i + 1 == k) for i, ((sse, _), b) in enumerate(zip(found, bic, strict=True))]
        self.breaks = np.array([low, *(self.at[i - 1] + spacing / 2 for i in found[k - 1][1][1:]), high])

    @property
    def zone(self) -> np.ndarray:
        return np.searchsorted(self.breaks[1:-1], self.at, side="left").astype(int) + 1


def _profiles(data: DataFrame, trial: str, schema: str, make: Callable[[_Profile], pd.DataFrame], response: str, along: str, n_zones: int | None = None, max_zones: int = 8, min_width: float | None = None, treat: str | None = None, block: str | None = None, method: str = "segment") -> DataFrame:
    factors = [f for f in (treat, block) if f]
    require_columns(data, trial, response, along, *factors)
    if method not in ("segment", "equal"):
        raise ValueError(f"unknown method: {method}")
    if method == "equal" and not n_zones:
        raise ValueError("method 'equal' needs n_zones")
    own = data.dropna(subset=[response, along, *factors]).select(*dict.fromkeys([trial, response, along, *factors]))
    return per_trial(own, trial, schema, lambda g: make(_Profile(g, response, along, factors, n_zones, max_zones, min_width, method)))


def partition_pseudo_env(data: DataFrame, trial: str, response: str, along: str, **options) -> DataFrame:
    """along and zone for each trial, by the profile mean of the response less the effects of treat and block.

    Options: method 'segment' (exact segments, their number by BIC unless n_zones is given) or 'equal'
    (n_zones slices of equal width), max_zones, min_width (the profile's practical range unless given),
    treat, block. Rows that lack a value aren't used.
    """
    return _profiles(data, trial, "along double, zone int", lambda p: pd.DataFrame({"along": p.at, "zone": p.zone}), response, along, **options)


def pseudo_env_zones(data: DataFrame, trial: str, response: str, along: str, **options) -> DataFrame:
    """Where the zones of partition_pseudo_env begin and end, and how many rows each has."""

    def table(p: _Profile) -> pd.DataFrame:
        n = pd.Series(p.size.to_numpy()).groupby(p.zone).sum().reindex(range(1, len(p.breaks)), fill_value=0)
        return pd.DataFrame({"zone": n.index, "start": p.breaks[:-1], "end": p.breaks[1:], "width": np.diff(p.breaks), "n": n.to_numpy()})

    return _profiles(data, trial, SEGMENTS, table, response, along, **options)


def pseudo_env_choice(data: DataFrame, trial: str, response: str, along: str, **options) -> DataFrame:
    """Squares and BIC by number of zones, with the profile's range and the least width that was kept to; no rows for equal slices."""
    names = [c.split()[0] for c in CHOICE.split(", ")]
    return _profiles(data, trial, CHOICE, lambda p: pd.DataFrame([(*t, p.range, p.width) for t in p.table], columns=names), response, along, **options)


JOINT = "trait string, level string, mean double, std_error double, correlation double, loglik double, converged boolean, n_both long"


def joint_table(grid: DataFrame, samples: DataFrame, sparse: str, trial: str = "trial", row: str = "row", col: str = "col") -> tuple[DataFrame, DataFrame]:
    """grid with the mean of the samples in each cell, and for each trial how many samples lie in no cell (n_off)."""
    require_columns(grid, trial, row, col)
    require_columns(samples, trial, row, col, sparse)
    key = [trial, row, col]
    own = samples.filter(F.col(sparse).isNotNull())
    off = own.join(grid.select(*key), key, "left_anti").groupBy(trial).agg(F.count("*").alias("n_off"))
    return grid.drop(sparse).join(own.groupBy(*key).agg(F.avg(sparse).alias(sparse)), key, "left"), off


def fit_integrated_joint(grid: DataFrame, samples: DataFrame, dense: str, sparse: str, trial: str = "trial", treat: str = "treat", block: str | None = None, row: str = "row", col: str = "col", residual: str = "ar1", min_overlap: int = 10, control: reml.Control = reml.Control(se=False)) -> DataFrame:
    """Treatment means of both layers of each trial from one bivariate fit, and the layers' correlation. Samples off the lattice aren't used (joint_table counts them)."""
    if dense == sparse:
        raise ValueError("the two responses must have different names")
    require_columns(grid, dense, treat, block)
    wide, _ = joint_table(grid, samples, sparse, trial, row, col)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        f = reml.fit_joint(g, dense, sparse, treat, block, row, col, residual, min_overlap, control)
        both = int((g[dense].notna() & g[sparse].notna()).sum())
        return f["means"].rename(columns={treat: "level"}).assign(correlation=f["correlation"], loglik=f["loglik"], converged=f["converged"], n_both=both)

    return per_trial(wide.select(*dict.fromkeys([trial, dense, sparse, treat, *([block] if block else []), row, col])), trial, JOINT, work)


def trial_wald(data: DataFrame, trial: str, fixed: str, random: str | None = None, residual: str = "~ ar1(row):ar1(col)", control: reml.Control = reml.Control(se=False)) -> DataFrame:
    """The Wald test of every fixed term of each trial's fit."""
    return per_trial(data, trial, "term string, df long, wald double, f double, p double", lambda g: reml.wald_tests(reml.fit_ofe(g, fixed, random, residual, control)))


def trial_pairs(data: DataFrame, trial: str, term: str, fixed: str, random: str | None = None, residual: str = "~ ar1(row):ar1(col)", by: str | None = None, adjust: str = "none", control: reml.Control = reml.Control(se=False)) -> DataFrame:
    """Pairwise differences of a term's average marginal means, for every trial."""
    schema = "level1 string, level2 string, contrast string, estimate double, std_error double, statistic double, p_value double, by string"
    return per_trial(data, trial, schema, lambda g: reml.ofe_means(reml.fit_ofe(g, fixed, random, residual, control), term, by, adjust_=adjust)[1])


def letters(comparisons: DataFrame, trial: str, alpha: float = 0.05) -> DataFrame:
    """level and letters of each trial's comparisons (level1, level2, p_value): two levels share a letter if and only if they don't differ."""
    own = comparisons.select(trial, "level1", "level2", "p_value")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        got = reml.compact_letters(g.sort_values(["level1", "level2"]), alpha)
        return pd.DataFrame({"level": list(got), "letters": list(got.values())})

    return per_trial(own, trial, "level string, letters string", work)


def fit_integrated(data: DataFrame, trial: str, response: str, treat: str, covariate: list[str] | None = None, random: str | None = None, row: str = "row", col: str = "col", engine: str = "reml") -> DataFrame:
    """The fixed effects (term, estimate, std_error) of each trial's response ~ treat + covariates. engine: 'reml' (AR1 by AR1), 'exp' (isotropic exponential with a nugget) or 'lm'."""
    return per_trial(data, trial, "term string, estimate double, std_error double", lambda g: reml.extract_fixed_effects(reml.fit_integrated(g, response, treat, covariate, random, row, col, engine)))


def compare_integration(data: DataFrame, trial: str, response: str, treat: str, covariate: list[str], engine: str = "reml", **options) -> DataFrame:
    """The full outer join of two fits' terms, without and with the covariates, and what changes."""
    side = lambda cov, name: fit_integrated(data, trial, response, treat, cov, engine=engine, **options).select(trial, "term", F.col("estimate").alias(f"estimate_{name}"), F.col("std_error").alias(f"std_error_{name}"))
    both = side(None, "baseline").join(side(covariate, "integrated"), [trial, "term"], "full_outer")
    return both.select("*", (F.col("estimate_integrated") - F.col("estimate_baseline")).alias("estimate_change"), (F.col("std_error_integrated") - F.col("std_error_baseline")).alias("se_change"))
