import json
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tilth import queries
from tilth.functions import reml, reports, zoning
from tilth.functions.distributions import adjust, f_tail, t_quantile, t_tail, tukey_tail
from tilth.functions.formulas import parse_residual
from tilth.functions.colours import MISSING, ofe_palette, ramp
from tilth.operators import clean, counts, design, maps, simulate, trials, variogram
from tilth.operators import grid as grid_ops
from tilth.operators.kriging import cv_krige_residuals, cv_krige_surface, krige, krige_point_samples, kriging_variogram
from tilth.operators.medians import group_medians, medians
from tilth.operators.simulate import surface
from tilth.sources import coordinates
from tilth.operators.variogram import Variogram

SF = "/root/testdata/sf0.001"


def test_distributions():
    assert t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6) and t_tail(1.5, 7) == pytest.approx(f_tail(2.25, 1, 7), abs=1e-12)
    for q, k, df in ((3.877, 3, 10), (4.232, 4, 20 - 4), (3.633, 3, 1e9 and 17.0)):
        assert 0 < tukey_tail(q, k, df) < 0.1
    assert tukey_tail(3.877, 3, 10) == pytest.approx(0.05, abs=5e-4) and tukey_tail(3.314, 3, math.inf) == pytest.approx(0.05, abs=5e-4)
    assert tukey_tail(2.5, 2, 9) == pytest.approx(t_tail(2.5 / math.sqrt(2), 9), abs=1e-4)


def test_adjustments():
    p = [0.01, 0.02, 0.03, 0.04]
    assert adjust(p, "holm") == pytest.approx([0.04, 0.06, 0.06, 0.06]) and adjust(p, "BH") == pytest.approx([0.04] * 4)
    assert adjust(p, "hochberg") == pytest.approx([0.04] * 4)
    rng = np.random.default_rng(0)
    for _ in range(20):
        p = rng.random(5) ** 3
        simes = lambda s: min(len(s) * v / (i + 1) for i, v in enumerate(sorted(p[list(s)])))
        closed = [max(simes(s) for k in range(1, 6) for s in combinations(range(5), k) if i in s) for i in range(5)]
        assert adjust(p, "hommel") == pytest.approx(closed)
    assert adjust([0.5, 0.6], "bonferroni") == [1.0, 1.0] and adjust([0.1], "sidak") == pytest.approx([0.1])


def grid(n_row=12, n_col=20, seed=3):
    r, c = np.mgrid[1 : n_row + 1, 1 : n_col + 1]
    d = pd.DataFrame({"row": r.ravel(), "col": c.ravel()})
    d["treat"] = np.array(list("ABC"))[(d["col"] - 1) * 3 // n_col]
    d["rep"] = ((d["row"] - 1) * 4 // n_row).astype(str)
    d["y"] = np.random.default_rng(seed).normal(size=len(d)) + (d["treat"] == "C") * 1.0
    return d


def test_independent_residual_is_least_squares():
    d = grid()
    f = reml.fit_ofe(d, "y ~ treat", residual="~ id(row):id(col)")
    x = np.column_stack([np.ones(len(d)), d["treat"] == "B", d["treat"] == "C"]).astype(float)
    beta = np.linalg.lstsq(x, d["y"], rcond=None)[0]
    s2 = ((d["y"] - x @ beta) ** 2).sum() / (len(d) - 3)
    assert np.allclose(f.beta, beta, atol=1e-10) and np.allclose(f.vcov, s2 * np.linalg.inv(x.T @ x), atol=1e-10)


def ar1_field(n_row, n_col, a, b, seed):
    rng = np.random.default_rng(seed)
    c = [np.linalg.cholesky(r ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))) for r, n in ((a, n_row), (b, n_col))]
    return (c[0] @ rng.normal(size=(n_row, n_col)) @ c[1].T).ravel()


def test_ar1_is_recovered_and_missing_rows_keep_their_lag():
    d = grid(24, 16)
    d["y"] = ar1_field(24, 16, 0.7, 0.4, 8)
    f = reml.fit_ofe(d.drop(index=range(5)), "y ~ treat")
    got = {n: (v, s) for n, v, s in f.varcomp}
    assert got["ar1(row)"][0] == pytest.approx(0.7, abs=0.12) and got["ar1(col)"][0] == pytest.approx(0.4, abs=0.15)
    assert 0 < got["ar1(row)"][1] < 0.2 and f.converged
    assert reml.ordinal(pd.Series([1, 2, 3, 5, 7])).tolist() == [1, 2, 3, 5, 7]


def test_random_terms_sections_and_contracts():
    d = grid()
    shift = {k: v for k, v in zip("0123", np.random.default_rng(1).normal(size=4) * 2, strict=True)}
    f = reml.fit_ofe(d.assign(y=d["y"] + d["rep"].map(shift)), "y ~ treat", "~ rep", "~ id(row):id(col)")
    assert dict((n, v) for n, v, _ in f.varcomp)["rep"] > 0.2
    z = d.assign(zone=np.where(d["row"] > 6, "b", "a"))
    z["y"] = np.where(z["zone"] == "b", 3 * z["y"], z["y"])
    two = reml.fit_ofe(z, "y ~ treat", residual="~ dsum(~ id(row):id(col) | zone)")
    assert dict((n, v) for n, v, _ in two.varcomp)["zone_b:variance"] == pytest.approx(9, rel=0.5)
    d2 = d.assign(copy=(d["treat"] == "B").astype(float))
    assert reml.fit_ofe(d2, "y ~ treat + copy", residual="~ id(row):id(col)").aliased == ["copy"]
    for bad in ("~ foo(row)", "~ id(row) + id(col)", "~ dsum(~ id(row) | zone, levels = [a])"):
        with pytest.raises(ValueError, match="."):
            reml.fit_ofe(z, "y ~ treat", residual=bad)
    with pytest.raises(ValueError, match="limit"):
        reml.fit_ofe(d, "y ~ treat", control=reml.Control(max_n=10))
    assert len(parse_residual("~ dsum(~ ar1(row) | z, levels = [a + b]) + dsum(~ id(col) | z, levels = [c])")) == 2


CASES = [
    ((0.40, 0.001, 0.002), True, {"A": "b", "B": "b", "C": "a"}),
    ((0.20, 0.001, 0.30), True, {"A": "b", "B": "ab", "C": "a"}),
    ((0.001, 0.001, 0.001), True, {"A": "c", "B": "b", "C": "a"}),
    ((0.9, 0.9, 0.9), True, {"A": "a", "B": "a", "C": "a"}),
    ((0.40, 0.001, 0.002), False, {"A": "a", "B": "a", "C": "b"}),
]


@pytest.mark.parametrize(("p", "decreasing", "want"), CASES)
def test_letters(p, decreasing, want):
    t = pd.DataFrame({"level1": list("AAB"), "level2": list("BCC"), "p_value": p})
    assert reml.compact_letters(t, 0.05, {"A": 1.0, "B": 2.0, "C": 3.0}, decreasing) == want


def test_letters_say_what_differs():
    rng = np.random.default_rng(2)
    names = [f"t{i}" for i in range(9)]
    for _ in range(30):
        t = pd.DataFrame([(a, b, rng.random()) for i, a in enumerate(names) for b in names[i + 1 :]], columns=["level1", "level2", "p_value"])
        l = reml.compact_letters(t, 0.5)
        assert all(bool(set(l[a]) & set(l[b])) == (p > 0.5) for a, b, p in t.itertuples(index=False))


def test_reports():
    f = reml.fit_ofe(grid(), "y ~ treat", residual="~ id(row):id(col)")
    w = reml.wald_tests(f)
    assert w["df"].tolist() == [1, 2] and w["p"].iloc[1] < 0.001
    means, pairs = reml.ofe_means(f, "treat", adjust_="tukey")
    assert np.allclose(means["mean"], grid().groupby("treat")["y"].mean()) and len(pairs) == 3
    lsd = reml.ofe_lsd(f, "treat", use="lsd")
    assert lsd["treat"].iloc[0] == "C" and lsd["letters"].iloc[0] == "a"
    more = reml.fit_integrated(grid().assign(z=lambda d: d["row"] * 0.1), "y", "treat", ["z"], engine="lm")
    assert set(reml.extract_fixed_effects(more)["term"]) == {"(Intercept)", "treatB", "treatC", "z"}


def test_joint_and_exponential_engines():
    d = grid(10, 9)
    rng = np.random.default_rng(5)
    field = ar1_field(10, 9, 0.5, 0.5, 4)
    d["dense"], d["sparse"] = field + 0.5 * rng.normal(size=90), 0.9 * field + 0.4 * rng.normal(size=90)
    d.loc[rng.choice(90, 60, replace=False), "sparse"] = np.nan
    j = reml.fit_joint(d, "dense", "sparse", "treat", residual="id")
    assert j["correlation"] > 0.4 and len(j["means"]) == 6
    e = reml.fit_integrated(d, "dense", "treat", engine="exp")
    assert {n for n, _, _ in e.varcomp} == {"iexp(row, col):range", "iexp(row, col):nugget", "sigma2"}
    with pytest.raises(ValueError, match="both traits"):
        reml.fit_joint(d, "dense", "sparse", "treat", min_overlap=80)


def test_kriging():
    rng = np.random.default_rng(6)
    xy = rng.random((60, 2)) * 50
    z = np.sin(xy[:, 0] / 9) + xy[:, 1] / 30
    p, v = krige(xy, z, np.vstack([xy[:3], [[25.0, 25.0], [500.0, 500.0]]]), Variogram("Exp", 0.05, 1.0, 10.0))
    assert np.allclose(p[:3], z[:3]) and np.allclose(v[:3], 0)
    assert p[3] == pytest.approx(np.sin(25 / 9) + 25 / 30, abs=0.4) and v[4] > 1.0 > v[3]


def test_segments_and_zones():
    mean = np.concatenate([np.zeros(22), np.full(18, 1.5)]) + 0.05 * np.random.default_rng(7).normal(size=40)
    found = zoning.segment_profile(mean, np.full(40, 12.0), 5, 4)
    assert found[1][1].tolist() == [0, 22] and 22 in found[int(np.argmin(zoning.segment_bic(found, 40, 480)))][1]
    r, c = (v.ravel() for v in np.mgrid[1:21, 1:21])
    z = (c > 8)[:, None] * 3.0 + 0.1 * np.random.default_rng(8).normal(size=(400, 1))
    place = {rc: i for i, rc in enumerate(zip(r, c, strict=True))}
    edges = np.array([(i, place[a + x, b + y]) for (a, b), i in place.items() for x, y in ((1, 0), (0, 1)) if (a + x, b + y) in place])
    for method in ("rectangle", "skater", "kmeans"):
        zone, table = zoning.partition(r, c, np.column_stack([c, r]).astype(float), z, edges, method)
        assert (zone == np.where(c > 8, 2, 1)).all() and table[1][2] > 0.95
    flat, _ = zoning.partition(r, c, np.column_stack([c, r]).astype(float), np.random.default_rng(9).normal(size=(400, 1)), edges)
    assert set(flat) == {1}


def test_neighbours_and_components():
    xy = np.random.default_rng(10).random((300, 2))
    far = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    want = {tuple(sorted((i, int(j)))) for i in range(300) for j in np.argsort(far[i])[:5]}
    assert {tuple(e) for e in zoning.nearest_edges(xy, 5, step=64).tolist()} == want
    assert len(zoning.nearest_edges(xy[:1], 5)) == 0
    z = np.random.default_rng(11).normal(size=(200, 3)) @ np.diag([5.0, 1.0, 0.1])
    s = zoning.principal(z, 2)
    assert np.allclose(s.var(axis=0, ddof=1), np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1][:2]) and np.corrcoef(s[:, 0], z[:, 0])[0, 1] > 0.99


@pytest.mark.parametrize("turn", [0.0, 0.5, 1.4])
def test_passes_by_place(spark, turn):
    rng = np.random.default_rng(12)
    own = np.repeat(np.arange(8), 80)
    along = np.tile(np.arange(80) * 2.0, 8)
    at = np.column_stack([along, own * 9.0 + 0.1 * rng.normal(size=640)]) @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
    rows = [("a", int(o), float(x), float(y)) for o, (x, y) in zip(own, at, strict=True)] + [("b", 0, 1.0, 1.0), ("c", 0, None, 1.0), *[("d", 0, 0.0, 0.0)] * 5]
    got = clean.derive_passes(spark.createDataFrame(rows, "trial string, own int, x double, y double")).collect()
    assert len(got) == len(rows)
    pairs = {(r["own"], r["pass"]) for r in got if r["trial"] == "a"}
    assert len(pairs) == 8 == len({p for _, p in pairs})
    assert {(r["trial"], r["pass"]) for r in got if r["trial"] != "a"} == {("b", 1), ("c", None), ("d", 1)}


def test_short_runs_join_the_one_before():
    assert clean.tidy_runs([10, 2, 10, 3]) == [1, 1, 2, 2]
    assert clean.tidy_runs([2, 10, 4, 10]) == [1, 1, 1, 2]
    assert clean.tidy_runs([2, 2]) == [1, 1] and clean.tidy_runs([1]) == [1] and clean.tidy_runs([]) == []


def test_passes_of_trials_of_different_scale(spark):
    track = [(t, p * 20 + k + 1, float(p * 9) * s, float(k if p % 2 == 0 else 19 - k) * s) for t, s in (("a", 1.0), ("b", 0.01)) for p in range(4) for k in range(20)]
    both = clean.derive_passes(spark.createDataFrame(track, "trial string, seq int, x double, y double"), "seq")
    assert {(r[0], r[1]) for r in both.groupBy("trial").agg({"pass": "max"}).collect()} == {("a", 4), ("b", 4)}


def test_exact_medians(spark):
    rng = np.random.default_rng(14)
    d = pd.DataFrame({"g": rng.integers(0, 7, 5000), "v": np.round(rng.normal(size=5000) ** 3, 2), "w": rng.integers(0, 4, 5000).astype(float)})
    d.loc[d["g"] == 6, "v"] = 3.0
    d.loc[rng.random(5000) < 0.1, "w"] = np.nan
    df = spark.createDataFrame(d)
    for bins, few in ((4096, 10_000), (8, 1), (8, 50)):
        got = medians(df, {"v": df["v"], "w": df["w"], "none": df["v"] * float("nan")}, bins, few)
        assert got == {"v": d["v"].median(), "w": d["w"].median(), "none": None}
    for bins in (1024, 4):
        got = {r["g"]: r["median"] for r in group_medians(df, ["g"], "v", bins=bins).collect()}
        assert got == d.groupby("g")["v"].median().to_dict()
    wide = spark.createDataFrame([(v,) for v in (-1e308, 1e308, 5.0, 7.0)], "v double")
    assert medians(wide, {"v": wide["v"]}, 4, 1)["v"] == 6.0


def test_cleaning_reads_a_table_a_few_times(spark, tmp_path):
    rng = np.random.default_rng(15)
    pd.DataFrame({"x": rng.random(900) * 100, "y": rng.random(900) * 60, "yield": rng.normal(5, 1, 900), "speed": rng.normal(2, 0.3, 900), "pass": rng.integers(0, 9, 900)}).to_parquet(tmp_path / "cloud.parquet")
    cloud = spark.read.parquet(str(tmp_path / "cloud.parquet"))
    marked = clean.clean_yield_monitor(cloud, pass_="pass", speed="speed", local_mad=3.0, pass_trim=2.0, edge_buffer=1.0, drop=False)
    for frame in (marked, clean.removal_tally(marked)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_texts():
    rng = np.random.default_rng(13)
    d = pd.DataFrame({"row": np.repeat(np.arange(8), 6), "col": np.tile(np.arange(6), 8), "treat": np.tile(list("ABC"), 16), "y": rng.normal(size=48)})
    f = reml.fit_ofe(d, "y ~ treat", residual="~ id(row):id(col)")
    text = reports.fit_text(f)
    assert "48 rows" in text and all(t in text for t in f.names)
    s = reports.fit_summary(f)
    assert np.allclose(s["statistic"] * s["std_error"], s["estimate"]) and [t_quantile(1 - p / 2, f.df) for p in s["p_value"]] == pytest.approx(s["statistic"].abs().tolist(), rel=1e-6)
    panels = reports.diagnostics(f).groupby("panel").size().to_dict()
    assert panels["fitted"] == panels["quantile"] == panels["map"] == 48 and panels["variogram"] > 3 and panels["smooth"] > 1
    line = reports.smoothed(np.arange(60.0), 3 * np.arange(60.0) + 1)
    assert np.allclose(line[:, 1], 3 * line[:, 0] + 1)
    assert "ratios to A" in reports.strip_text({"df": (2, 9), "f": 3.0, "p": 0.1, "reference": "A", "ratios": [("B", 1.1, 0.9, 1.3)]})
    assert "2 plots, 2 treatments, 1 replicates" in reports.design_text(pd.DataFrame({"x": [1.0, 2.0], "y": [1.0, 1.0], "plot": [1, 2], "tier": 1, "rep": 1, "treat": list("AB")}))
    bins = pd.DataFrame({"h": [1.0], "gamma": [0.5], "n_pair": [9]})
    assert "practical range 30" in reports.variogram_text(bins, Variogram("Exp", 0.2, 1.0, 10.0))


def test_surface_has_its_variance_and_range():
    f = np.array([surface(np.random.default_rng(s), 40, 40, 12.0) for s in range(60)])
    assert f.var() == pytest.approx(1, abs=0.15)
    assert np.mean(f[:, :-4] * f[:, 4:]) == pytest.approx(math.exp(-1), abs=0.1)


def test_pseudo_environments_less_treatments(spark):
    rows = [(1, r, c, "ab"[c > 6], 10.0 * (c > 6) + 0.1 * ((r * 7 + c * 3) % 5)) for r in range(1, 9) for c in range(1, 13)]
    data = spark.createDataFrame(rows, "trial int, row int, col int, treat string, y double")
    zones = lambda **options: [r["zone"] for r in trials.partition_pseudo_env(data, "trial", "y", "col", max_zones=4, min_width=2.0, **options).orderBy("along").collect()]
    assert zones() != [1] * 12 and zones(treat="treat") == [1] * 12
    assert zones(method="equal", n_zones=3) == [1] * 4 + [2] * 4 + [3] * 4


def test_count_precision_is_registered_in_full(spark):
    assert queries.count_precision(spark, SF).collect() == counts.count_precision(spark, [4, 8, 16], n_sim=400).collect()


def test_fit_is_registered_with_standard_errors(spark):
    found = [se for r in queries.fit_ofe(spark, SF).collect() if r["varcomp"] for name, _, se in json.loads(r["varcomp"]) if name != "sigma2"]
    assert found and any(not math.isnan(se) for se in found)


def test_every_level_of_a_map_has_a_colour(spark):
    cells = spark.createDataFrame([(float(i % 40), float(i // 40), f"level {i:04d}") for i in range(1200)] + [(0.0, 30.0, None)], "x double, y double, kind string")
    fills = {r["value"]: r["fill"] for r in maps.ofe_map(cells, "kind").collect()}
    assert fills == dict(zip((f"level {i:04d}" for i in range(1200)), ofe_palette("treatment", 1200), strict=True)) | {None: MISSING}
    over = maps.ofe_map(cells, "kind", overlay=lambda m: m.limit(1).withColumn("label", m["value"]))
    assert over.count() == 1202 and "label" in over.columns


def test_palettes():
    assert ofe_palette("treatment", 3) == ["#2a78d6", "#1baf7a", "#eda100"] and ofe_palette("zone", 1) == ["#0d366b"]
    assert ofe_palette("surface", 6)[::5] == ["#cde2fb", "#0d366b"] and ofe_palette("chrome")["ink"] == "#0b0b0b"
    grey = ramp(("#000000", "#ffffff"), 3)
    assert grey == ["#000000", "#777777", "#ffffff"]  # half the lightness of white


def test_count_presets_and_fields():
    assert counts.count_preset() == {"mean_density": 120.0, "var_cell": 0.015, "patch_range": 20.0, "var_trend": 0.01, "trend_range": 200.0, "var_patch": 0.03}
    assert counts.count_preset("canola", "low")["var_patch"] == 0 and counts.count_preset("weeds")["var_patch"] == 0.6
    with pytest.raises(ValueError, match="trend_range"):
        counts.count_preset("custom", mean_density=1.0)
    field = counts._Field(60, 24, 20.0, 0.5)
    f = np.array([field.draw(np.random.default_rng(s)) for s in range(150)])
    assert f.var() == pytest.approx(1, abs=0.2) and abs(np.mean(f[:, :-40] * f[:, 40:])) < 0.25


def test_counts_without_a_field_are_poisson(spark):
    flat = {"mean_density": 40.0, "var_cell": 0.0, "var_patch": 0.0, "patch_range": 20.0, "var_trend": 0.0, "trend_range": 200.0}
    t = counts.count_precision(spark, [4, 16], 2, 0.25, "custom", n_sim=600, **flat).orderBy("n_stations").collect()
    for r in t:
        assert r["rmse"] == pytest.approx(1 / math.sqrt(40 * 0.25 * r["counts"]), rel=0.12) and abs(r["bias"]) < 0.02
    assert [r["counts"] for r in t] == [8, 32]
    one = counts.count_sample_size(spark, t[1]["margin95"] * 1.01, 16, n_quadrats=2, crop="custom", n_sim=600, **flat).first()
    assert 12 <= one["n_stations"] <= 16
    assert counts.count_sample_size(spark, 0.001, 3, crop="custom", n_sim=20, **flat).first()["n_stations"] is None
    with pytest.raises(ValueError, match="buffers"):
        counts.count_precision(spark, [4], strip_width=4.0)


def test_kriging_through_spark_is_the_plain_system(spark):
    rng = np.random.default_rng(16)
    xy = np.round(rng.random((80, 2)) * 60, 3)
    z = np.sin(xy[:, 0] / 8) + 0.1 * rng.normal(size=80)
    v = Variogram("Exp", 0.05, 1.0, 12.0)
    points = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "v": z}))
    to = rng.random((40, 2)) * 60
    got = krige_point_samples(points, spark.createDataFrame(pd.DataFrame({"x": to[:, 0], "y": to[:, 1]})), "v", variogram=v, nmax=12).toPandas()

    def plain(p, xy, z):
        near = np.argsort(np.hypot(*(xy - p).T))[:12]
        a = np.ones((13, 13))
        a[:12, :12] = v.gamma(np.hypot(*(xy[near][:, None] - xy[near][None]).transpose(2, 0, 1)))
        a[12, 12] = 0
        b = np.append(v.gamma(np.hypot(*(xy[near] - p).T)), 1)
        w = np.linalg.solve(a, b)
        return w[:12] @ z[near], w @ b

    want = np.array([plain(p, xy, z) for p in got[["x", "y"]].to_numpy()])
    assert np.allclose(got[["v_kriged", "v_kriged_var"]], want)
    r = cv_krige_residuals(points, "v", variogram=v, nmax=12).toPandas()
    for x, y, o, p, e in r.itertuples(index=False):
        i = int(np.argmin(np.hypot(xy[:, 0] - x, xy[:, 1] - y)))
        assert p == pytest.approx(plain(xy[i], np.delete(xy, i, 0), np.delete(z, i))[0]) and e == pytest.approx(o - p)
    s = cv_krige_surface(points, "v", variogram=v, nmax=12).first()
    assert s["rmse"] == pytest.approx(np.sqrt((r["residual"] ** 2).mean())) and s["n"] == 80
    found, source = kriging_variogram(points, "v")
    assert source == "weighted refinement" and found.practical > 0
    few, source = kriging_variogram(points.limit(6), "v")
    assert source == "scale" and few.model == "Exp"
    with pytest.raises(ValueError, match="too few"):
        variogram.ofe_variogram(points.limit(6), "v")
    far = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)).max()
    assert variogram.longest_distance(points) == pytest.approx(far)


def test_paddocks_keep_all_cells_and_say_what_zones_are(spark):
    rows = [("a", r, c, None if (r, c) == (3, 3) else 3.0 * (c > 8) + 0.1 * ((7 * r + 3 * c) % 5), 1.0, "ab"[r % 2]) for r in range(1, 13) for c in range(1, 17)]
    cells = spark.createDataFrame(rows, "trial string, row int, col int, v double, flat double, treat string")
    got = trials.partition_paddock(cells, "trial", ["v", "flat"]).collect()
    assert len(got) == 192 and [r["zone"] for r in got if (r["row"], r["col"]) == (3, 3)] == [None]
    z = trials.paddock_zones(cells, "trial", ["v"], treat="treat").orderBy("zone").collect()
    assert [(r["n"], r["patches"], r["x_min"], r["x_max"], r["y_min"], r["y_max"], r["treatments"]) for r in z] == [(95, 1, 1, 8, 1, 12, 2), (96, 1, 9, 16, 1, 12, 2)]
    assert z[0]["area"] == 95 and z[1]["mean_v"] == pytest.approx(np.mean([r[3] for r in rows if r[2] > 8]))
    t = trials.paddock_criteria(cells, "trial", ["v"]).orderBy("k").collect()
    assert [r["chosen"] for r in t[:3]] == [False, True, False] and t[1]["r2"] > 0.95 and t[1]["gain"] == pytest.approx(t[1]["r2"])
    for bad in ({"covariates": ["flat"]}, {"covariates": ["v"], "k": 90}, {"covariates": ["v", "v"]}):
        with pytest.raises(Exception, match="constant|need more|each once"):
            trials.partition_paddock(cells, "trial", **bad).collect()


def test_pseudo_environments_say_how_they_were_cut(spark):
    rows = [(1, r, c, 2.0 * (c > 6) + 0.1 * ((r * 7 + c * 3) % 5)) for r in range(1, 9) for c in range(1, 13)]
    data = spark.createDataFrame(rows, "trial int, row int, col int, y double")
    z = trials.pseudo_env_zones(data, "trial", "y", "col", min_width=2.0, max_zones=4).orderBy("zone").collect()
    assert [(r["start"], r["end"], r["width"], r["n"]) for r in z] == [(0.5, 6.5, 6.0, 48), (6.5, 12.5, 6.0, 48)]
    c = trials.pseudo_env_choice(data, "trial", "y", "col", min_width=2.0, max_zones=4).orderBy("n_zones").collect()
    assert [r["chosen"] for r in c] == [False, True, False, False] and c[0]["sse"] > 10 * c[1]["sse"]
    with pytest.raises(Exception, match="can't be reached"):
        trials.pseudo_env_zones(data, "trial", "y", "col", min_width=6.0, n_zones=4).collect()


def test_fits_through_spark_are_the_plain_fits(spark):
    d = pd.concat([grid(8, 6).assign(trial=k, y=lambda g, k=k: g["y"] + k * (g["row"] % 3)) for k in (1, 2)])
    df = spark.createDataFrame(d)
    got = trials.fit_trials(df, "trial", "y ~ treat", residual="~ id(row):id(col)").toPandas()
    wald = trials.trial_wald(df, "trial", "y ~ treat", residual="~ id(row):id(col)").toPandas()
    for k, own in d.groupby("trial"):
        f = reml.fit_ofe(own, "y ~ treat", residual="~ id(row):id(col)")
        mine = got[got["trial"] == k].set_index("term")
        assert np.allclose(mine.loc[f.names, "estimate"], f.beta) and np.allclose(mine.loc[f.names, "std_error"], np.sqrt(np.diag(f.vcov)))
        assert np.allclose(wald[wald["trial"] == k]["f"], reml.wald_tests(f)["f"])
    letters = trials.letters(trials.trial_pairs(df, "trial", "treat", "y ~ treat", residual="~ id(row):id(col)"), "trial").toPandas()
    assert len(letters) == 6 and letters["letters"].notna().all()
    both = trials.compare_integration(df.withColumn("z", df["row"] * 1.0), "trial", "y", "treat", ["z"], engine="lm").toPandas()
    assert len(both) == 8 and both["estimate_change"].isna().sum() == 2


def test_simulated_paddocks_hold_what_was_asked(spark):
    p = simulate.simulate_paddock(spark, [3], n_zones=2, treatments=["a", "b"], treat_effect=[0.0, 1.0], zone_effect=[1.0, 0.0], noise_sd=0.0).toPandas()
    assert len(p) == 960 and p["zone"].value_counts().to_dict() == {1: 480, 2: 480}
    up = p["yield"] - p["yield_potential"]
    assert np.allclose(up[(p["treat"] == "b") & (p["zone"] == 1)], 1) and np.allclose(up[(p["treat"] == "a") | (p["zone"] == 2)], 0)
    assert p.groupby("rep")["treat"].nunique().tolist() == [2] * 4 and p["yield_potential"].std() == pytest.approx(0.6)
    cor = np.array([list(r)[1:3] for r in simulate.paddock_truth(simulate.simulate_paddock(spark, list(range(8))), ["elevation", "clay"]).collect()])
    assert cor.mean() == pytest.approx(0.6, abs=0.15)
    with pytest.raises(ValueError, match="too few"):
        simulate.simulate_paddock(spark, [1], n_col=5, treatments=["a", "b"])


def test_simulated_harvest(spark):
    h = simulate.Harvest(defects=simulate.Defects())
    c = simulate.simulate_yield_monitor(spark, [4], h).toPandas()
    assert not ((c["x"] / 240 - 0.8).clip(lower=0) + (c["y"] / 108 - 0.8).clip(lower=0) > 0.2 + 1e-6).any()
    assert c.groupby("pass")["x"].first().iloc[:2].tolist() == [0.0, 240.0] and c["seq"].tolist() == list(range(1, len(c) + 1))
    assert {"pass_start", "pass_end", "outlier"} == set(c["defect"].dropna()) and (c["defect"] == "outlier").mean() == pytest.approx(0.02, abs=1e-3)
    assert len(simulate.simulate_yield_monitor(spark, [4], simulate.Harvest(skip_pass_prob=0.0, cut_corner=False)).select("pass").distinct().collect()) == 12
    ends = simulate.simulate_yield_samples(spark, [4], design="strip_ends").toPandas()
    assert len(ends) <= 30 and ((ends["x"] < 40) | (ends["x"] > 150)).all()
    cleaned = clean.clean_yield_monitor(simulate.simulate_yield_monitor(spark, [4], h), pass_="pass", speed="speed", pass_trim=13.0, min_yield=0.0).toPandas()
    assert cleaned["defect"].isna().mean() > 0.97


def test_stations(spark):
    d = design.make_trial_design(spark, ["A", "B"], 2)
    s = design.place_count_stations(d, plot_width=18.0, plot_length=200.0).toPandas()
    assert len(s) == 4 * 8 * 2 and s["along"].between(20, 180).all() and (s["x"] % 18).between(2, 16).all()
    one = design.place_count_stations(d, n_quadrats=1).toPandas()
    assert one.groupby("station")["along"].nunique().tolist() == [1] * 8
    apart = design.place_count_stations(d, n_quadrats=1, same_positions=False).toPandas()
    assert apart[apart["station"] == 1]["along"].nunique() == 4
    free = design.place_count_stations(d, n_quadrats=1, layout="random").toPandas().sort_values(["plot", "station"])
    assert free.groupby("plot")["along"].apply(lambda v: v.is_monotonic_increasing).all()
    for bad in ({"end_buffer": 100.0}, {"side_buffer": 9.0}, {"layout": "spiral"}):
        with pytest.raises(ValueError, match="room|layout"):
            design.place_count_stations(d, **bad)


def test_nested_samples_keep_their_spacings(spark):
    g = spark.createDataFrame([(float(i), float(j)) for i in range(60) for j in range(60)], "x double, y double")
    near = design.place_point_samples(g, 20, "nested", spacings=[2.0, 4.0]).toPandas().to_numpy()
    far = np.hypot(*(near[:, None] - near[None]).transpose(2, 0, 1))
    np.fill_diagonal(far, np.inf)
    assert len(near) == 20 and np.median(far.min(axis=1)) < 4
    corners = design.place_point_samples(g, 16, "grid").toPandas().to_numpy()
    assert {(0.0, 0.0), (59.0, 59.0)} <= set(map(tuple, corners))


def test_cell_function_and_default_sizes(spark):
    cells = spark.createDataFrame([(float(i % 10), float(i // 10), float(i)) for i in range(100)], "x double, y double, v double")
    spread = grid_ops.grid_dense_layer(cells, "x", "y", "v", None, 5.0, lambda s: s.max() - s.min()).collect()
    assert {r["v"] for r in spread} == {44.0}
    assert grid_ops.default_sizes(cells, "x", "y") == [1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0]
    t = grid_ops.choose_cell_size(cells, "v", "x", "y").orderBy("cell_size").collect()
    assert [r["chosen"] for r in t] == [False, True, False, False, False, False, False] and t[0]["pure"] is None and t[1]["usable"] == 25


def test_complete_lattices_are_solved_by_axis():
    d = grid(9, 7).sample(frac=1, random_state=3)
    res = reml.Residual(parse_residual("~ ar1(row):ar1(col)"), d)
    lattice, rng = reml.Lattice.of(res), np.random.default_rng(18)
    x, y = np.column_stack([np.ones(63), rng.normal(size=63)]), rng.normal(size=63)
    for theta in ([0.7, 0.4], [-0.5, 0.9]):
        for a, b in zip(lattice.solve(y, x, np.array(theta)), reml._solve(y, x, res.matrix(np.array(theta), 63)), strict=True):
            assert np.allclose(a, b)
    assert reml.Lattice.of(reml.Residual(parse_residual("~ id(row):exp(col)"), d)) is not None
    assert reml.Lattice.of(reml.Residual(parse_residual("~ ar1(row):ar1(col)"), d.iloc[1:])) is None
    c = np.linalg.cholesky(res.matrix(np.array([0.3, 0.2]), 63))
    assert np.allclose(reml._forward(c, x, 8), np.linalg.solve(c, x))


def test_projection(spark):
    d = spark.createDataFrame([(150.0 + k * 1e-4, -30.0 + k * 1e-4) for k in range(50)] + [(None, 1.0)], "long double, lat double")
    p = coordinates.along_and_across(coordinates.project(d)).toPandas()
    assert p["x"].isna().sum() == 1 and p["across"].max() < 1e-6
    assert p["along"].max() == pytest.approx(49e-4 * math.hypot(111320 * math.cos(math.radians(30.0)), 110540), rel=1e-3)
