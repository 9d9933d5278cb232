import threading

import duckdb
import numpy as np
import pytest

from tilth import queries
from tilth.operators import clean, design, grid, trials, variogram, zones
from tilth.functions.colours import ink_on, ofe_palette
from tilth.operators.maps import ofe_map

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "events", "customer"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def cloud(spark):
    return spark.createDataFrame([(float(i % 30), float(i // 30), "ABC"[i % 30 // 10], float(i % 7)) for i in range(600)], "x double, y double, treat string, yield double")


def test_one_cell_by_hand(spark):
    rows = [(0.0, 0.0, "A", 1.0), (1.0, 1.0, "A", 3.0), (1.5, 0.5, "B", None), (12.0, 6.0, "C", 8.0), (None, 1.0, "C", 9.0), (float("nan"), 1.0, "C", 9.0)]
    got = {(r["row"], r["col"]): r for r in grid.grid_dense_layer(spark.createDataFrame(rows, "x double, y double, treat string, yield double"), "x", "y", "yield", "treat", 5.0).collect()}
    assert len(got) == 6
    assert (got[1, 1]["yield"], got[1, 1]["n_obs"], got[1, 1]["treat"], round(got[1, 1]["treat_purity"], 6)) == (2.0, 2, "A", 0.666667)
    assert (got[1, 2]["yield"], got[1, 2]["n_obs"], got[1, 2]["treat"]) == (None, 0, None)
    with pytest.raises(ValueError, match="not found: z"):
        grid.grid_dense_layer(cloud(spark), "z", "y", "yield")


def test_edges_and_passes(spark):
    square = spark.createDataFrame([(float(5 * i), float(5 * j), 1.0) for i in range(21) for j in range(13)], "x double, y double, yield double")
    kept = clean.clean_yield_monitor(square, outlier_mad=None, edge_buffer=5.0)
    assert kept.count() == 19 * 11
    track = [(t, p * 20 + k + 1, float(p * 9), float(k if p % 2 == 0 else 19 - k)) for t in ("a", "b") for p in range(4) for k in range(20)]
    got = clean.derive_passes(spark.createDataFrame(track, "trial string, seq int, x double, y double"), "seq").groupBy("trial").agg({"pass": "max"}).collect()
    assert {r[1] for r in got} == {4}


def test_passes_without_an_order(spark):
    rows = [(t, float(k), p * 9.0) for t in ("a", "b") for p in range(4) for k in range(20)] + [("a", None, 1.0)]
    got = clean.derive_passes(spark.createDataFrame(rows, "trial string, x double, y double")).collect()
    assert len(got) == 161 and {(r["pass"], r["y"]) for r in got if r["x"] is not None} == {(p + 1, p * 9.0) for p in range(4)}
    assert [r["pass"] for r in got if r["x"] is None] == [None]


def test_zones_by_nearest_cells_and_components(spark):
    rows = [("a", r, c, 3.0 * (c > 8) + 0.1 * ((7 * r + 3 * c) % 5), 6.0 * (c > 8) + 0.1 * ((3 * r + c) % 7)) for r in range(1, 13) for c in range(1, 17)]
    cells = spark.createDataFrame(rows, "trial string, row int, col int, v double, w double")
    got = trials.partition_paddock(cells, "trial", ["v", "w"], "skater", neighbours="knn", n_pc=1).collect()
    assert len(got) == 192 and all(g["zone"] == (2 if g["col"] > 8 else 1) for g in got)
    with pytest.raises(ValueError, match="unknown neighbours"):
        trials.partition_paddock(cells, "trial", ["v"], neighbours="king")


def test_tally_adds_up(spark):
    marked = clean.clean_yield_monitor(cloud(spark), yield_range=(1, 5), outlier_mad=2.0, drop=False)
    t = {r["rule"]: r["removed"] for r in clean.removal_tally(marked).collect()}
    assert sum(t.values()) == 600 and t["range"] == sum(i % 7 in (0, 6) for i in range(600))


def test_design_has_every_treatment_in_every_rep(spark):
    d = design.make_trial_design(spark, ["A", "B", "C"], 4, seed=5)
    assert d.groupBy("rep").agg({"treat": "count"}).count() == 4
    assert d.select("rep", "treat").distinct().count() == 12 and d.filter("treat is null").count() == 0
    for bad in ({"treatments": ["A"]}, {"treatments": ["A", "B"], "cell_size": 99.0}, {"treatments": ["A", "B", "C"], "n_rep": 1, "layout": "stack"}):
        with pytest.raises(ValueError, match="."):
            design.make_trial_design(spark, **bad)


@pytest.mark.parametrize("kind", ["random", "grid", "stratified", "nested"])
def test_placement_is_exact(spark, kind):
    g = spark.createDataFrame([(float(i), float(j), "ab"[i > 9]) for i in range(20) for j in range(15)], "x double, y double, s string")
    got = design.place_point_samples(g, 23, kind, strata="s" if kind == "stratified" else None).collect()
    assert len(got) == len(set(got)) == 23
    with pytest.raises(ValueError, match="samples asked"):
        design.place_point_samples(g, 999, kind)


def test_sample_interval_published_values(spark):
    r = variogram.kriging_sample_interval(spark, 0.2, 1.0, 30.0, target_kse=0.7).filter("chosen").first()
    assert r["rel_kse"] == pytest.approx(0.67454, abs=1e-4) and r["floor"] == pytest.approx(0.40825, abs=1e-5)


def test_variogram_recovers_a_range(spark):
    import numpy as np

    h = np.arange(1.0, 20)
    v = variogram.fit_variogram(h, 0.2 + 1.0 * (1 - np.exp(-h / 5)), np.full(19, 50.0), ("Exp",))
    assert v.practical == pytest.approx(15, rel=0.05) and v.nugget == pytest.approx(0.2, abs=0.05)


def test_formula_and_maps(spark):
    s = spark.createDataFrame([("1", "ar1(row):ar1(col)"), ("2", "id(row):ar1(col)")], "zone string, structure string")
    assert zones.residual_formula(s) == "~ dsum(~ ar1(row):ar1(col) | zone, levels = [1]) + dsum(~ id(row):ar1(col) | zone, levels = [2])"
    assert len(ofe_palette("residual", 9)) == 9 and ofe_palette("residual", 9)[4] == "#f0efec" and ink_on("#FFFFFF") == "#0b0b0b" and ink_on("#101010") == "#fcfcfb"
    m = ofe_map(cloud(spark), "treat").first()
    assert m["xmax"] - m["xmin"] == 1.0 and m["fill"] in ofe_palette("treatment", 3)


def test_cleaning_stream(spark, tmp_path):
    from tilth.streaming.cleaning import clean_stream, grid_stream

    src = spark.read.parquet(f"{SF}/events.parquet").selectExpr("ts", "value as yield", "cast(event_id % 50 as double) as x", "cast(event_id % 7 as double) as y")
    src.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = grid_stream(clean_stream(stream, yield_range=(0, 1e9)), "ts", "yield").writeStream.format("memory").queryName("gridded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("gridded").agg({"n_obs": "sum"}).first()[0] > 0


@pytest.fixture
def limited(spark):
    """Ends all jobs after two minutes, so that work on pairs of rows fails and doesn't hang."""
    t = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    t.start()
    yield
    t.cancel()


def test_pairs_of_rows_of_few_places(spark, limited):
    n = 300_000  # rows a place
    points = spark.range(4 * n).selectExpr("double(id % 4) x", "0D y", "double(id div 4 % 5 + id % 4) v")
    got = {r["bin"]: (r["h"], r["gamma"], r["n_pair"]) for r in variogram.pair_bins(points, "v", cutoff=3.0, n_bin=3).collect()}
    assert got == {h: (h, pytest.approx(2 + h**2 / 2), (4 - h) * n * n) for h in (1, 2, 3)}


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_pairs_where_places_repeat(spark, odd):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(v)) for a, b, v in zip(rng.integers(-6, 6, 80), rng.integers(0, 4, 80), rng.normal(1e6, 1, 80), strict=True)] + [(0.0, 1.0, odd), (0.0, 1.0, 5.0), (-0.0, 1.0, 5.0)]
    want, known = {}, [r for r in rows if r[2] is not None and r[2] == r[2]]
    for i, a in enumerate(known):
        for b in known[:i]:
            h = np.hypot(a[0] - b[0], a[1] - b[1])
            if 0 < h <= 4:
                want.setdefault(max(int(np.ceil(h / 0.8)), 1), []).append((h, (a[2] - b[2]) ** 2 / 2))
    got = variogram.pair_bins(spark.createDataFrame(rows, "x double, y double, v double"), "v", cutoff=4.0, n_bin=5).collect()
    assert {r["bin"]: (r["h"], r["gamma"], r["n_pair"]) for r in got} == {k: (pytest.approx(np.mean([h for h, _ in p])), pytest.approx(np.mean([g for _, g in p])), len(p)) for k, p in want.items() if len(p) > 1}


def test_finer_squares_find_the_same_pairs(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(float(a), float(b), float(v)) for a, b, v in zip(rng.integers(-20, 20, 150) / 10, rng.integers(-9, 9, 150) / 10, rng.normal(size=150), strict=True)], "x double, y double, v double")
    coarse, *others = ([tuple(r) for r in variogram.pair_bins(points, "v", cutoff=0.3, n_bin=5, fine=f).orderBy("bin").collect()] for f in (1, 2, 3, 4))
    assert [r[0] for r in coarse] == [2, 3, 4, 5] and all(np.allclose(o, coarse, rtol=1e-9) for o in others)


def test_variogram_meets_the_pairs_once(spark, limited):
    points = spark.range(1_500_000).selectExpr("double(id % 30) x", "double(id % 20) y", "double(id % 30 + id % 7) v")
    bins, v = variogram.ofe_variogram(points, "v", trend=["x"])
    assert "Join" not in bins._jdf.queryExecution().optimizedPlan().toString()
    assert bins.agg({"n_pair": "sum"}).first()[0] > 10**11 and v.nugget + v.psill > 0
