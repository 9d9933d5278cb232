"""Text of fits and variograms, and the points of a fit's diagnostic panels."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd

from tilth.functions.distributions import t_tail
from tilth.functions.reml import Fit


def _rows(table: pd.DataFrame) -> list[str]:
    return table.to_string(index=False, float_format=lambda v: f"{v:.5g}").splitlines()


def fit_summary(fit: Fit) -> pd.DataFrame:
    """The coefficients with t and its two-sided p on n - p degrees of freedom."""
    c = fit.coefficients
    t = c["estimate"] / c["std_error"]
    return c.assign(statistic=t, p_value=[t_tail(v, fit.df) if np.isfinite(v) else np.nan for v in t])


def fit_text(fit: Fit, coefficients: bool = True) -> str:
    """What was fitted, the variance components and, unless left out, the coefficients."""
    lines = [f"REML fit of {fit.response}: {fit.n} rows, {fit.n_dropped} dropped, log likelihood {fit.loglik:.4f}"]
    if not fit.converged:
        lines.append("Not converged.")
    if fit.aliased:
        lines.append("Aliased: " + ", ".join(fit.aliased))
    lines += ["", *_rows(pd.DataFrame(fit.varcomp, columns=["component", "estimate", "std_error"]))]
    if coefficients:
        lines += ["", *_rows(fit_summary(fit))]
    return "\n".join(lines)


def variogram_text(bins: pd.DataFrame, v) -> str:
    """The model's numbers over its bins."""
    sill = v.nugget + v.psill
    share = v.nugget / sill if sill else np.nan
    head = f"{v.model}: nugget {v.nugget:.4g}, sill {sill:.4g}, practical range {v.practical:.4g}, nugget share {share:.2f}"
    return "\n".join([head, "", *_rows(bins)])


def strip_text(result: dict) -> str:
    """The F test of a strip analysis and the ratio of each treatment to the reference."""
    df1, df2 = result["df"]
    head = f"Treatments: F({df1}, {df2}) = {result['f']:.3f}, p = {result['p']:.4g}; ratios to {result['reference']}"
    return "\n".join([head, "", *_rows(pd.DataFrame(result["ratios"], columns=["treat", "ratio", "lower", "upper"]))])


def design_text(cells: pd.DataFrame) -> str:
    """Plots, treatments and replicates of a design's cells, and its extent."""
    own = cells.dropna(subset=["plot"])
    book = own.drop_duplicates(["tier", "plot"]).sort_values(["tier", "plot"])
    step = [min((np.diff(np.unique(cells[c]))), default=0.0) for c in ("x", "y")]
    size = [np.ptp(cells[c]) + s for c, s in zip(("x", "y"), step, strict=True)]
    head = f"{len(book)} plots, {own['treat'].nunique()} treatments, {own['rep'].nunique()} replicates, {size[0]:g} by {size[1]:g} m ({size[0] * size[1] / 1e4:.2f} ha)"
    return "\n".join([head, "", *_rows(book[["tier", "plot", "rep", "treat"]])])


def residual_bins(xy: np.ndarray, residuals: np.ndarray, n_bin: int = 15, most: int = 1500) -> pd.DataFrame:
    """h, gamma, n_pair of residuals up to a third of the longest distance, from at most `most` evenly chosen rows."""
    at = np.unique(np.linspace(0, len(xy) - 1, min(len(xy), most)).astype(int))
    i, j = np.triu_indices(len(at), 1)
    h, g = np.hypot(*(xy[at][i] - xy[at][j]).T), (residuals[at][i] - residuals[at][j]) ** 2 / 2
    cutoff = h.max(initial=0.0) / 3
    near = (h > 0) & (h <= cutoff)
    k = np.maximum(np.ceil(h[near] / (cutoff / n_bin)), 1).clip(max=n_bin) if near.any() else np.zeros(0)
    t = pd.DataFrame({"k": k, "h": h[near], "gamma": g[near]}).groupby("k").agg(h=("h", "mean"), gamma=("gamma", "mean"), n_pair=("h", "size"))
    return t[t["n_pair"] >= 2].reset_index(drop=True)


def smoothed(x: np.ndarray, y: np.ndarray, share: float = 2 / 3, points: int = 50) -> np.ndarray:
    """A local linear fit at evenly spread places of x: the nearest share of the points, tricube weights, twice reweighted by the residuals."""
    k = max(2, int(np.ceil(share * len(x))))
    at = np.unique(np.quantile(x, np.linspace(0, 1, min(points, len(x)))))
    trust = np.ones(len(x))
    for again in range(3):
        out = []
        for v in at if again == 2 else x:
            far = np.abs(x - v)
            h = max(np.partition(far, k - 1)[k - 1], 1e-12)
            w = trust * (1 - np.minimum(far / h, 1) ** 3) ** 3
            mx, my = np.average(x, weights=w + 1e-12), np.average(y, weights=w + 1e-12)
            slope = (w * (x - mx) * (y - my)).sum() / max((w * (x - mx) ** 2).sum(), 1e-300)
            out.append(my + slope * (v - mx))
        if again < 2:
            off = np.abs(y - np.array(out))
            trust = (1 - np.minimum(off / max(6 * np.median(off), 1e-12), 1) ** 2) ** 2
    return np.column_stack([at, out])


def diagnostics(fit: Fit, row: str = "row", col: str = "col") -> pd.DataFrame:
    """panel, x, y, value: 'map' (residuals in space), 'fitted' (against fitted values) with its 'smooth' line, 'quantile' (against normal quantiles), 'variogram' of the residuals (value: pairs).

    Without both position columns there is no map and no variogram.
    """
    order = np.sort(fit.residuals)
    p = (np.arange(1, len(order) + 1) - 0.5) / len(order)
    parts = [pd.DataFrame({"panel": "fitted", "x": fit.fitted, "y": fit.residuals}), pd.DataFrame({"panel": "quantile", "x": [NormalDist().inv_cdf(v) for v in p], "y": order})]
    if len(order) > 10 and np.ptp(fit.fitted) > 0:
        line = smoothed(fit.fitted, fit.residuals)
        parts.append(pd.DataFrame({"panel": "smooth", "x": line[:, 0], "y": line[:, 1]}))
    if {row, col} <= set(fit.data.columns):
        xy = np.column_stack([pd.to_numeric(fit.data[c].astype(str), errors="coerce").to_numpy(float) for c in (col, row)])
        parts.append(pd.DataFrame({"panel": "map", "x": xy[:, 0], "y": xy[:, 1], "value": fit.residuals}))
        ok = np.isfinite(xy).all(axis=1)
        b = residual_bins(xy[ok], fit.residuals[ok])
        parts.append(pd.DataFrame({"panel": "variogram", "x": b["h"], "y": b["gamma"], "value": b["n_pair"].astype(float)}))
    return pd.concat(parts, ignore_index=True)


def variogram_curve(v, longest: float, points: int = 100) -> pd.DataFrame:
    """h, gamma of a fitted model from just above 0 to longest."""
    h = np.linspace(longest / points, longest, points)
    return pd.DataFrame({"h": h, "gamma": v.gamma(h)})
