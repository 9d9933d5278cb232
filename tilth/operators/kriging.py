"""Local ordinary kriging of a sparse layer onto a lattice, and its leave-one-out validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.operators.variogram import FINE, Variogram, fit_variogram, ofe_variogram, pair_bins
from tilth.semantics import number, require_columns

#: Samples are a sparse layer: more than this many are not sent to every task.
MOST_SAMPLES = 100_000
#: Targets that are solved together.
TOGETHER = 256


class Nearest:
    """The k nearest of some points, by squares that hold a few points each."""

    def __init__(self, xy: np.ndarray, per_square: int = 8):
        self.xy, self.low = xy, xy.min(axis=0)
        span = np.maximum(np.ptp(xy, axis=0), 1e-12)
        self.side = float(max(np.sqrt(span.prod() * per_square / len(xy)), span.max() * 1e-4))
        self.shape = (np.floor(span / self.side).astype(int) + 1).tolist()
        square = self._square(xy)
        self.order = np.argsort(square, kind="stable")
        self.starts = np.searchsorted(square[self.order], np.arange(self.shape[0] * self.shape[1] + 1))

    def _square(self, at: np.ndarray) -> np.ndarray:
        c = np.clip(np.floor((at - self.low) / self.side).astype(int), 0, np.array(self.shape) - 1)
        return c[:, 0] * self.shape[1] + c[:, 1]

    def find(self, at: np.ndarray, k: int) -> np.ndarray:
        """Indices of the k nearest points to each row of at; of places that share a square the candidates are found once."""
        out = np.empty((len(at), k), int)
        squares = self._square(at)
        for square in np.unique(squares):
            rows = np.nonzero(squares == square)[0]
            r, c = divmod(int(square), self.shape[1])
            reach = 1
            while True:
                found = [self.order[self.starts[i * self.shape[1] + max(c - reach, 0)] : self.starts[i * self.shape[1] + min(c + reach, self.shape[1] - 1) + 1]] for i in range(max(r - reach, 0), min(r + reach, self.shape[0] - 1) + 1)]
                near = np.concatenate(found)
                whole = reach >= max(self.shape)
                if len(near) >= k or whole:
                    far = np.hypot(*(self.xy[near][None] - at[rows][:, None]).transpose(2, 0, 1))
                    pick = np.argpartition(far, k - 1, axis=1)[:, :k]
                    furthest = np.take_along_axis(far, pick, 1).max()
                    # all points up to this distance from the targets are among the candidates
                    box = np.array([[max(r - reach, 0), max(c - reach, 0)], [min(r + reach, self.shape[0] - 1) + 1, min(c + reach, self.shape[1] - 1) + 1]]) * self.side + self.low
                    edge = np.where([[r - reach <= 0, c - reach <= 0], [r + reach >= self.shape[0] - 1, c + reach >= self.shape[1] - 1]], np.inf, np.abs(np.stack([at[rows].min(axis=0) - box[0], box[1] - at[rows].max(axis=0)])))
                    if whole or furthest <= edge.min():
                        out[rows] = near[pick]
                        break
                reach *= 2
        return out


def krige(xy: np.ndarray, z: np.ndarray, to: np.ndarray, v: Variogram, nmax: int = 30, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and variances at `to` from the nmax nearest samples; at a sample's own place its value, variance 0. without: for each target a sample that is left out."""
    out = np.zeros((len(to), 2))
    nearest = Nearest(xy)
    k = min(nmax, len(z) - (without is not None))
    for i in range(0, len(to), TOGETHER):
        at = to[i : i + TOGETHER]
        near = nearest.find(at, k + (without is not None))
        if without is not None:
            far = np.hypot(*(xy[near] - at[:, None]).transpose(2, 0, 1))
            far[near == without[i : i + TOGETHER, None]] = np.inf
            near = np.take_along_axis(near, np.argsort(far, axis=1, kind="stable")[:, :k], 1)
        d = np.hypot(*(xy[near] - at[:, None]).transpose(2, 0, 1))
        a = np.ones((len(at), k + 1, k + 1))
        a[:, :k, :k] = v.gamma(np.hypot(*(xy[near][:, :, None] - xy[near][:, None]).transpose(3, 0, 1, 2)))
        a[:, k, k] = 0
        b = np.concatenate([v.gamma(d), np.ones((len(at), 1))], axis=1)
        try:
            w = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            w = np.stack([np.linalg.lstsq(m, r, rcond=None)[0] for m, r in zip(a, b, strict=True)])
        out[i : i + TOGETHER, 0] = (w[:, :k] * z[near]).sum(axis=1)
        out[i : i + TOGETHER, 1] = np.maximum((w * b).sum(axis=1), 0)
        on = np.nonzero(d.min(axis=1) == 0)[0]
        out[i + on, 0], out[i + on, 1] = z[near[on, d[on].argmin(axis=1)]], 0.0
    return out[:, 0], out[:, 1]


def _samples(points: DataFrame, value: str, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values, repeated places averaged. ValueError beyond MOST_SAMPLES."""
    s = points.select(number(x).alias("x"), number(y).alias("y"), number(value).alias("v")).dropna().groupBy("x", "y").agg(F.avg("v").alias("v")).orderBy("x", "y").limit(MOST_SAMPLES + 1).toPandas()
    if len(s) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples: grid them as a dense layer")
    if len(s) < 4:
        raise ValueError("at least four samples are needed")
    return s[["x", "y"]].to_numpy(float), s["v"].to_numpy(float)


def refined(start: Variogram, h, gamma, n_pair) -> Variogram | None:
    """The start's model refitted with weights n / h squared, which favour short distances; None where that leaves no sill or range."""
    h = np.asarray(h, float)
    v = fit_variogram(h, gamma, np.asarray(n_pair, float) / h**2, (start.model,))
    return v if v is not None and np.isfinite([v.nugget, v.psill, v.a]).all() and v.a > 0 and v.nugget + v.psill > 0 else None


def kriging_variogram(points: DataFrame, value: str, x: str = "x", y: str = "y", n_bin: int = 15) -> tuple[Variogram, str]:
    """The variogram that kriging uses, and its source: 'weighted refinement' of the constrained fit, the 'constrained fit', or 'scale' of the data where samples are too few for either."""
    own = points.select(number(x).alias("x"), number(y).alias("y"), number(value).alias("v")).dropna()
    try:
        _, start = ofe_variogram(own, "v")
    except ValueError:
        r = own.agg(F.var_samp("v").alias("v"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent")).first()
        if not r["extent"]:
            raise ValueError("samples in one place say nothing about distance") from None
        return Variogram("Exp", 0.1 * (r["v"] or 1.0), 0.9 * (r["v"] or 1.0), r["extent"] / 4), "scale"
    b = own.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    bins = pair_bins(own, "v", "x", "y", float(np.hypot(*b)) / 3, n_bin, FINE).orderBy("bin").collect()  # n_bin rows at most
    better = refined(start, *([r[c] for r in bins] for c in ("h", "gamma", "n_pair"))) if len(bins) >= 3 else None
    return (better, "weighted refinement") if better else (start, "constrained fit")


def krige_point_samples(points: DataFrame, newdata: DataFrame, value: str, x: str = "x", y: str = "y", variogram: Variogram | None = None, nmax: int = 30) -> DataFrame:
    """newdata with <value>_kriged and <value>_kriged_var; rows without a place get null. The variogram is kriging_variogram's unless given."""
    require_columns(points, value, x, y)
    require_columns(newdata, x, y)
    v = variogram or kriging_variogram(points, value, x, y)[0]
    xy, z = _samples(points, value, x, y)

    def work(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            to = np.column_stack([a, b]).astype(float)
            ok = np.isfinite(to).all(axis=1)
            out = np.full((len(to), 2), np.nan)
            if ok.any():
                out[ok] = np.column_stack(krige(xy, z, to[ok], v, nmax))
            yield pd.DataFrame({"k": out[:, 0], "v": out[:, 1]})

    got = newdata.withColumn("_k", F.pandas_udf(work, "k double, v double")(number(x), number(y)))
    return got.withColumn(f"{value}_kriged", F.nanvl("_k.k", F.lit(None))).withColumn(f"{value}_kriged_var", F.nanvl("_k.v", F.lit(None))).drop("_k")


def cv_krige_residuals(points: DataFrame, value: str, x: str = "x", y: str = "y", variogram: Variogram | None = None, nmax: int = 30) -> DataFrame:
    """x, y, observed, predicted and residual of every sample, each predicted from all others."""
    v = variogram or kriging_variogram(points, value, x, y)[0]
    xy, z = _samples(points, value, x, y)
    spark = points.sparkSession

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i = b["id"].to_numpy()
            if len(i):
                p = krige(xy, z, xy[i], v, nmax, without=i)[0]
                yield pd.DataFrame({"x": xy[i, 0], "y": xy[i, 1], "observed": z[i], "predicted": p, "residual": z[i] - p})

    return spark.range(len(z)).mapInPandas(work, "x double, y double, observed double, predicted double, residual double")


def cv_krige_surface(points: DataFrame, value: str, x: str = "x", y: str = "y", variogram: Variogram | None = None, nmax: int = 30) -> DataFrame:
    """One row: rmse, r2 (1 - SSE / SST, may be negative; null without spread), n, from cv_krige_residuals."""
    got = cv_krige_residuals(points, value, x, y, variogram, nmax)
    sse = F.sum(F.pow("residual", F.lit(2)))
    return got.agg(F.sqrt(sse / F.count("*")).alias("rmse"), (1 - F.try_divide(sse, F.var_pop("observed") * F.count("*"))).alias("r2"), F.count("*").alias("n"))
