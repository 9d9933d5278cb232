"""The registered queries of the trial operators, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilth.functions.colours import MISSING, ink_on, ofe_palette
from tilth.operators import clean, counts, design, grid, kriging, maps, simulate, trials, variogram, zones
from tilth.plans.views import prefix, view
from tilth.sources import coordinates, known_answer as published

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, views: tuple[str, ...] = ()):
    """Adds a query, and its SQL behind the views that it names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = prefix(*views) if views else ""
            SQL[f.__name__] = f"{head}{', ' if views and sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
        return f

    return add


def _r(*names: str):
    """Sums of doubles differ in the last bits with the order; six places don't."""
    return [F.round(n, 6).alias(n) for n in names]


# Cells of 12 by 9 over a view: the common start of several statements.
CELLS = """+
b AS (SELECT *, min(x) OVER () AS x0, min(y) OVER () AS y0 FROM {view} WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT *, CAST(floor((x - x0) / {w}) + 1 AS INTEGER) AS col, CAST(floor((y - y0) / {w}) + 1 AS INTEGER) AS row FROM b)"""


@register(
    CELLS.format(view="cloud", w="9.0")
    + """,
m AS (SELECT row, col, avg(yield) AS yield, count(yield) AS n_obs FROM c GROUP BY row, col),
v AS (SELECT row, col, treat, count(*) AS n FROM c WHERE treat IS NOT NULL GROUP BY row, col, treat),
t AS (SELECT row, col, treat, n / sum(n) OVER (PARTITION BY row, col) AS treat_purity, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, treat) AS k FROM v),
s AS (SELECT max(row) AS rows, max(col) AS cols, min(x0) AS x0, min(y0) AS y0 FROM c),
l AS (SELECT r.row, k.col, x0, y0 FROM s, (SELECT CAST(unnest(range(1, (SELECT rows FROM s) + 1)) AS INTEGER) AS row) r, (SELECT CAST(unnest(range(1, (SELECT cols FROM s) + 1)) AS INTEGER) AS col) k)
SELECT l.row, l.col, x0 + (l.col - 0.5) * 9.0 AS x_centre, y0 + (l.row - 0.5) * 9.0 AS y_centre, round(m.yield, 6) AS yield, coalesce(n_obs, 0) AS n_obs, t.treat, round(treat_purity, 6) AS treat_purity
FROM l LEFT JOIN m USING (row, col) LEFT JOIN (SELECT * FROM t WHERE k = 1) t USING (row, col)""",
    ("cloud",),
)
def grid_dense_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.grid_dense_layer(view(spark, sf_dir, "cloud"), "x", "y", "yield", "treat", 9.0)
    return g.select("row", "col", "x_centre", "y_centre", *_r("yield"), "n_obs", "treat", *_r("treat_purity"))


@register(
    CELLS.format(view="cloud_banded", w="10.0")
    + """,
m AS (SELECT row, col, avg(yield) AS yield, min(treat) AS treat FROM c GROUP BY row, col HAVING min(treat) = max(treat))
SELECT treat, count(*) AS cells, round(avg(yield), 6) AS mean_yield FROM m GROUP BY treat""",
    ("cloud_banded",),
)
def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.grid_dense_layer(view(spark, sf_dir, "cloud_banded"), "x", "y", "yield", "treat", 10.0)
    return g.filter("treat_purity = 1").groupBy("treat").agg(F.count("*").alias("cells"), F.round(F.avg("yield"), 6).alias("mean_yield"))


@register(
    """+
b AS (SELECT x - min(x) OVER () AS x, y - min(y) OVER () AS y, yield, treat FROM cloud_banded WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT unnest([4.0, 8.0, 12.0, 20.0])::DOUBLE AS cell_size),
c AS (SELECT cell_size, floor(x / cell_size) + 1 AS c, floor(y / cell_size) + 1 AS r, count(yield) AS n, count(DISTINCT treat) AS k FROM b, s GROUP BY 1, 2, 3),
t AS (SELECT cell_size, (max(c) * max(r))::BIGINT AS cells, count(*) FILTER (WHERE n > 0) AS occupied, round_even(count(*) FILTER (WHERE n > 0) / (max(c) * max(r)), 3) AS coverage, median(n) FILTER (WHERE n > 0) AS median_obs, round_even(avg((k = 1)::INT) FILTER (WHERE n > 0 AND k > 0), 3) AS pure, count(*) FILTER (WHERE n >= 3 AND k = 1) AS usable FROM c GROUP BY 1)
SELECT *, coalesce(cell_size = (SELECT min(cell_size) FROM t WHERE median_obs >= 3 AND pure >= 0.7), false) AS chosen FROM t""",
    ("cloud_banded",),
)
def choose_cell_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.choose_cell_size(view(spark, sf_dir, "cloud_banded"), "yield", "x", "y", "treat", [4.0, 8.0, 12.0, 20.0])


@register()
def choose_cell_size_by_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.choose_cell_size(view(spark, sf_dir, "points").dropDuplicates(["x", "y"]), "value", "x", "y")


@register(
    CELLS.format(view="cloud", w="9.0")
    + """
SELECT row, col, x0 + (col - 0.5) * 9.0 AS x_centre, y0 + (row - 0.5) * 9.0 AS y_centre, CASE WHEN count(yield) >= 15 THEN round(median(yield), 6) END AS yield, count(yield) AS n_obs FROM c GROUP BY row, col, x0, y0""",
    ("cloud",),
)
def grid_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.grid_dense_layer(view(spark, sf_dir, "cloud"), "x", "y", "yield", None, 9.0, "median", n_min=15, keep_empty=False)
    return g.select("row", "col", "x_centre", "y_centre", *_r("yield"), "n_obs")


CLEAN = """+
g AS (SELECT *, median(yield) OVER () AS m, median(speed) OVER () AS sm, greatest(max(x) OVER () - min(x) OVER (), max(y) OVER () - min(y) OVER ()) / 20 AS side, min(x) OVER () AS x0, min(y) OVER () AS y0 FROM cloud),
h AS (SELECT *, 1.4826 * median(abs(yield - m)) OVER () AS s, 1.4826 * median(abs(speed - sm)) OVER () AS ss, abs(yield - median(yield) OVER (PARTITION BY floor((x - x0) / side), floor((y - y0) / side))) AS dev FROM g),
k AS (SELECT *, 1.4826 * median(dev) OVER () AS ds FROM h),
z AS (SELECT *, CASE WHEN yield IS NULL OR x IS NULL OR y IS NULL THEN 'missing' WHEN yield < 905 OR yield > 2000 THEN 'range' WHEN yield <= 910 THEN 'zero' WHEN s > 0 AND abs(yield - m) > 1.5 * s THEN 'outlier' WHEN ds > 0 AND dev > 2.2 * ds THEN 'local' WHEN speed <= 0 OR (ss > 0 AND abs(speed - sm) > 1.2 * ss) THEN 'speed' END AS reason FROM k)"""


def _marked(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return clean.clean_yield_monitor(view(spark, sf_dir, "cloud"), speed="speed", yield_range=(905.0, 2000.0), min_yield=910.0, outlier_mad=1.5, local_mad=2.2, speed_mad=1.2, drop=False, **more)


@register(CLEAN + " SELECT x, y, yield, pass, reason FROM z", ("cloud",))
def clean_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("x", "y", "yield", "pass", F.col("`.reason`").alias("reason"))


@register(
    CLEAN
    + """, n AS (SELECT unnest(['missing', 'range', 'zero', 'outlier', 'local', 'speed', 'pass_end', 'edge', 'kept']) AS rule),
t AS (SELECT coalesce(reason, 'kept') AS rule, count(*) AS removed FROM z GROUP BY 1)
SELECT n.rule, coalesce(removed, 0) AS removed, round(100.0 * coalesce(removed, 0) / (SELECT count(*) FROM z), 6) AS percent FROM n LEFT JOIN t USING (rule)""",
    ("cloud",),
)
def clean_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.removal_tally(_marked(spark, sf_dir)).select("rule", "removed", *_r("percent"))


@register(
    """+
a AS (SELECT *, 0.5 * atan2(2 * covar_samp(x, y) OVER w, var_samp(x) OVER w - var_samp(y) OVER w) AS angle, count(*) OVER w AS n FROM track WINDOW w AS (PARTITION BY pass)),
b AS (SELECT *, x * cos(angle) + y * sin(angle) AS along FROM a),
c AS (SELECT *, min(along) OVER (PARTITION BY pass) AS first, max(along) OVER (PARTITION BY pass) AS last FROM b)
SELECT seq, pass, coalesce(n < 2 OR least(along - first, last - along) < 3.3, false) AS is_end FROM c""",
    ("track",),
)
def clean_pass_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = clean.clean_yield_monitor(view(spark, sf_dir, "track"), pass_="pass", outlier_mad=None, pass_trim=3.3, drop=False)
    return m.select("seq", "pass", F.coalesce(F.col("`.reason`") == "pass_end", F.lit(False)).alias("is_end"))


@register(
    """+ SELECT id, yield IS NOT NULL AND least(x, 100 - x, y, 60 - y) < 7.5 AS is_edge FROM square""",
    ("square",),
)
def clean_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = clean.clean_yield_monitor(view(spark, sf_dir, "square"), outlier_mad=None, edge_buffer=7.5, drop=False)
    return m.select("id", F.coalesce(F.col("`.reason`") == "edge", F.lit(False)).alias("is_edge"))


@register(
    """+
s AS (SELECT seq, trial, count(*) OVER (PARTITION BY trial) AS points, x - lag(x) OVER w AS sx, y - lag(y) OVER w AS sy, x - lag(x, 3) OVER w AS bx, y - lag(y, 3) OVER w AS by_, lead(x, 3) OVER w - x AS ax, lead(y, 3) OVER w - y AS ay FROM tracks WINDOW w AS (PARTITION BY trial ORDER BY seq)),
t AS (SELECT *, sqrt(sx * sx + sy * sy) AS step FROM s),
u AS (SELECT trial, median(step) AS usual FROM t WHERE step > 0 GROUP BY trial)
SELECT seq, t.trial, coalesce(step > 4 * usual, false) OR coalesce(points > 7 AND bx * ax + by_ * ay < 0, false) AS is_break FROM t LEFT JOIN u ON t.trial = u.trial""",
    ("tracks",),
)
def pass_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.pass_breaks(view(spark, sf_dir, "tracks"), "seq", by="trial").select("seq", "trial", "is_break")


@register()
def derive_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.derive_passes(view(spark, sf_dir, "tracks"), "seq").groupBy("trial", "pass").agg(F.count("*").alias("n"))


@register()
def derive_passes_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.derive_passes(view(spark, sf_dir, "tracks")).groupBy("trial", "pass").agg(F.count("*").alias("n"))


@register(
    """WITH b AS (SELECT r * 3 + p + 1 AS plot, r + 1 AS rep, ['A', 'B', 'C'][p + 1] AS treat FROM range(4) t(r), range(3) u(p)),
c AS (SELECT r + 1 AS row, k + 1 AS col, (k + 0.5) * 9.0 AS x, (r + 0.5) * 9.0 AS y FROM range(47) t(r), range(12) u(k)),
d AS (SELECT *, CASE WHEN y <= 200 THEN 1 WHEN y > 230 THEN 2 END AS tier, floor(x / 18.0) + 1 AS place FROM c)
SELECT row::INT AS row, col::INT AS col, x::DOUBLE AS x, y::DOUBLE AS y, coalesce(b.treat, '') AS treat, coalesce(b.rep, 0)::INT AS rep, coalesce(b.plot, 0)::INT AS plot, coalesce(tier, 0) AS tier FROM d LEFT JOIN b ON floor((b.plot - 1) / 6) + 1 = d.tier AND (b.plot - 1) % 6 + 1 = d.place"""
)
def make_trial_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = design.make_trial_design(spark, ["A", "B", "C"], 4, "stack", gap=30.0, randomise=False)
    return d.fillna("", "treat").fillna(0, ["rep", "plot", "tier"])  # cells of the gap


@register(
    """WITH p AS (SELECT i + 1 AS plot, ['A', 'B'][i % 2 + 1] AS treat, floor(i / 2) + 1 AS rep, i * 18.0 AS x0 FROM range(4) t(i)),
u AS (SELECT *, k + 1 AS station, q + 1 AS quadrat, ('0x' || substr(md5(concat_ws('|', 1, 'x', plot, k + 1, q + 1)), 1, 8))::UBIGINT / 4294967296.0 AS ux, ('0x' || substr(md5(concat_ws('|', 1, 'y', plot, k + 1, q + 1)), 1, 8))::UBIGINT / 4294967296.0 AS uy FROM p, range(8) t(k), range(2) v(q)),
s AS (SELECT *, least(greatest(20 + (station - 1 + 0.25) * 160.0 / 8 + (2 * uy - 1) * 2.5, 20), 180) AS along FROM u)
SELECT plot::INT AS plot, 1 AS tier, treat, rep::INT AS rep, station::INT AS station, quadrat::INT AS quadrat, round(x0 + 2 + ux * 14, 6)::DOUBLE AS x, round(along, 6)::DOUBLE AS y, round(along, 6)::DOUBLE AS along FROM s"""
)
def place_count_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = design.make_trial_design(spark, ["A", "B"], 2, randomise=False)
    return design.place_count_stations(d, start=0.25, plot_width=18.0, plot_length=200.0).withColumns({c: F.round(c, 6) for c in ("x", "y", "along")})


@register()
def place_random_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.place_count_stations(design.make_trial_design(spark, ["A", "B"], 2), layout="random", cell_size=9.0)


@register(
    CELLS.format(view="cloud", w="9.0")
    + """,
s AS (SELECT max(row) AS rows, max(col) AS cols, min(x0) AS x0, min(y0) AS y0 FROM c),
l AS (SELECT r.row, k.col, x0 + (k.col - 0.5) * 9.0 AS x_centre, y0 + (r.row - 0.5) * 9.0 AS y_centre FROM s, (SELECT CAST(unnest(range(1, (SELECT rows FROM s) + 1)) AS INTEGER) AS row) r, (SELECT CAST(unnest(range(1, (SELECT cols FROM s) + 1)) AS INTEGER) AS col) k)
SELECT row, col, x_centre, y_centre FROM l ORDER BY ('0x' || substr(md5(concat_ws('|', 1, x_centre, y_centre)), 1, 8))::UBIGINT, x_centre, y_centre LIMIT 30""",
    ("cloud",),
)
def place_random_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.grid_dense_layer(view(spark, sf_dir, "cloud"), "x", "y", "yield", None, 9.0)
    return design.place_point_samples(g, 30, "random", "x_centre", "y_centre").select("row", "col", "x_centre", "y_centre")


@register()
def place_point_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.grid_dense_layer(view(spark, sf_dir, "cloud"), "x", "y", "yield", "treat", 9.0)
    return design.place_point_samples(g, 24, "stratified", "x_centre", "y_centre", "treat").select("row", "col", "x_centre", "y_centre", "treat")


@register(
    """SELECT strip, min(treat) AS treat, min(block) AS block, count(*) AS quadrats, sum(count)::DOUBLE AS count, sum(area) AS area, round(sum(count) / sum(area), 6) AS density, CAST(NULL AS DOUBLE) AS baseline, round(ln((sum(count) + 0.5) / sum(area)), 6) AS response FROM quadrats GROUP BY strip""",
    ("quadrats",),
)
def strip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counts.strip_summary(view(spark, sf_dir, "quadrats"), "count", "strip", "treat", "block", "area")
    return s.withColumns({"density": F.round("density", 6), "response": F.round("response", 6)})


# Blocks are complete, so least squares are differences of means; 2.1447866879169273 is Student's 0.975 quantile on 14 degrees of freedom, and a tail of F on 2 degrees has a closed form.
@register(
    """+
r AS (SELECT strip, min(treat) AS treat, min(block) AS block, ln((sum(count) + 0.5) / sum(area)) AS y FROM quadrats GROUP BY strip),
m AS (SELECT *, avg(y) OVER (PARTITION BY treat) AS mt, avg(y) OVER (PARTITION BY block) AS mb, avg(y) OVER () AS ma FROM r),
e AS (SELECT sum((y - mt - mb + ma) ** 2) / 14 AS s2, sum((mt - ma) ** 2) / 2 AS ms FROM m),
t AS (SELECT DISTINCT treat, mt FROM m)
SELECT t.treat, round(exp(t.mt - a.mt), 6) AS ratio, round(exp(t.mt - a.mt - 2.1447866879169273 * sqrt(s2 / 4)), 6) AS lower, round(exp(t.mt - a.mt + 2.1447866879169273 * sqrt(s2 / 4)), 6) AS upper, round(ms / s2, 6) AS f, round((1 + ms / s2 / 7) ** -7, 6) AS p FROM t, e, t a WHERE a.treat = '0' AND t.treat <> '0'""",
    ("quadrats",),
)
def analyse_strip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = counts.analyse_strip_counts(view(spark, sf_dir, "quadrats"), "count", "strip", "treat", "block", "area")
    return spark.createDataFrame([(*r, a["f"], a["p"]) for r in a["ratios"]], "treat string, ratio double, lower double, upper double, f double, p double").select("treat", *_r("ratio", "lower", "upper", "f", "p"))


@register()
def count_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_precision(spark, [4, 8, 16])


@register()
def count_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_sample_size(spark, 0.2, 16)


@register()
def ofe_variogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins, v = variogram.ofe_variogram(view(spark, sf_dir, "points"), "value", trend=["x"])
    return spark.createDataFrame([(v.model, v.nugget, v.psill, v.a, v.practical, variogram.identified(v, bins))], "model string, nugget double, psill double, range double, practical double, identified boolean")


@register(
    """+
p AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h, (a.value - b.value) ** 2 / 2 AS g FROM points a JOIN points b ON a.id < b.id)
SELECT least(greatest(ceil(h / (30.0 / 15)), 1), 15)::INT AS bin, round(avg(h), 6) AS h, round(avg(g), 3) AS gamma, count(*) AS n_pair FROM p WHERE h <= 30 AND h > 0 GROUP BY 1 HAVING count(*) >= 2""",
    ("points",),
)
def variogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variogram.pair_bins(view(spark, sf_dir, "points"), "value", cutoff=30.0).select("bin", *_r("h"), F.round("gamma", 3).alias("gamma"), "n_pair")


@register(
    """WITH d AS (SELECT 30.0 / 20 + i * (60.0 - 1.5) / 59 AS d FROM range(60) t(i)),
v AS (SELECT d, 2 * (0.2 + 1 - exp(-(d / sqrt(2)) / 10)) - (8 * (0.2 + 1 - exp(-d / 10)) + 4 * (0.2 + 1 - exp(-d * sqrt(2) / 10))) / 16 AS v FROM d),
r AS (SELECT *, sqrt(v) / sqrt(1.2) AS k FROM v)
SELECT round(d, 6)::DOUBLE AS interval, round(v, 6)::DOUBLE AS variance, round(k, 6)::DOUBLE AS rel_kse, round(sqrt(0.2 / 1.2), 6)::DOUBLE AS floor, ceil(400000 / (d * d))::BIGINT AS n_samples, coalesce(d = (SELECT max(d) FROM r WHERE k <= 0.7), false) AS chosen FROM r"""
)
def kriging_sample_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = variogram.kriging_sample_interval(spark, 0.2, 1.0, 30.0, target_kse=0.7, area_ha=40.0)
    return t.select(*_r("interval", "variance", "rel_kse", "floor"), "n_samples", "chosen")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "points").filter("value is not null").groupBy("x", "y").agg(F.avg("value").alias("value"))


@register()
def krige_point_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lattice = spark.range(12 * 10).select((F.col("id") % 12 * 20 + 10.5).alias("x"), (F.floor(F.col("id") / 12) * 10 + 5.5).alias("y"))
    return kriging.krige_point_samples(_samples(spark, sf_dir), lattice, "value")


@register()
def cv_krige_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriging.cv_krige_surface(_samples(spark, sf_dir), "value")


@register()
def cv_krige_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriging.cv_krige_residuals(_samples(spark, sf_dir), "value")


@register(
    """+
c AS (SELECT DISTINCT CAST(floor(x / 12) + 1 AS INTEGER) AS col, CAST(floor(y / 9) + 1 AS INTEGER) AS row FROM cloud)
SELECT a.row, a.col, b.row AS row2, b.col AS col2 FROM c a JOIN c b ON (b.row - a.row, b.col - a.col) IN ((1, 0), (0, 1), (1, 1), (1, -1))""",
    ("cloud",),
)
def cell_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cloud").select((F.floor(F.col("y") / 9) + 1).cast("int").alias("row"), (F.floor(F.col("x") / 12) + 1).cast("int").alias("col"))
    return zones.cell_neighbours(cells, "queen")


@register(
    """+
p AS (SELECT floor(x / 8) AS k, avg(yield) AS m FROM cloud GROUP BY 1), q AS (SELECT m, row_number() OVER (ORDER BY k) AS k FROM p)
SELECT l.lag::INT AS lag, round(avg((a.m - b.m) ** 2) / 2, 6) AS gamma, count(*) AS n_pair FROM (SELECT unnest(range(1, 11)) AS lag) l, q a, q b WHERE b.k = a.k + l.lag GROUP BY 1""",
    ("cloud",),
)
def profile_semivariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "cloud").withColumn("k", F.floor(F.col("x") / 8))
    return zones.profile_semivariance(c, "yield", "k", 10).select("lag", *_r("gamma"), "n_pair")


@register(
    """+
c AS (SELECT pass % 3 AS region, CAST(floor(y / 9) AS BIGINT) AS row, CAST(floor(x / 12) AS BIGINT) AS col, speed AS v FROM cloud),
t AS (SELECT region, 1 AS place, 'row' AS axis, row AS cut, count(v) AS n, sum(v) AS s FROM c GROUP BY 1, 4 UNION ALL SELECT region, 2, 'col', col, count(v), sum(v) FROM c GROUP BY 1, 4),
u AS (SELECT *, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER q AS nt, sum(s) OVER q AS st FROM t WINDOW w AS (PARTITION BY region, place ORDER BY cut), q AS (PARTITION BY region, place)),
g AS (SELECT *, s1 * s1 / n1 + (st - s1) * (st - s1) / (nt - n1) - st * st / nt AS gain FROM u WHERE n1 >= 5 AND nt - n1 >= 5)
SELECT region, axis, cut, round(gain, 3) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY gain DESC, place, cut) AS k FROM g) WHERE k = 1""",
    ("cloud",),
)
def best_rectangle_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "cloud").select((F.col("pass") % 3).alias("region"), F.floor(F.col("y") / 9).alias("row"), F.floor(F.col("x") / 12).alias("col"), "speed")
    return zones.best_rectangle_cut(c, "speed", "region").withColumn("gain", F.round("gain", 3))


@register(
    """+ c AS (SELECT *, pass % 4 AS zone FROM cloud)
SELECT zone, count(*) AS cells, count(*) * 0.01::DOUBLE AS area, round(avg(yield), 6) AS mean_yield, round(avg(speed), 6) AS mean_speed, count(DISTINCT treat) AS treatments FROM c GROUP BY zone""",
    ("cloud",),
)
def zone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = zones.zone_summary(view(spark, sf_dir, "cloud").withColumn("zone", F.col("pass") % 4), "zone", ["yield", "speed"], "treat", 0.01)
    return s.withColumns({"mean_yield": F.round("mean_yield", 6), "mean_speed": F.round("mean_speed", 6)})


@register(
    """+ c AS (SELECT pass AS zone, CAST(floor(y / 100) AS BIGINT) AS row, CAST(floor(x / 12) AS BIGINT) AS col FROM cloud)
SELECT zone, CASE WHEN count(DISTINCT row) >= 2 THEN 'ar1(row)' ELSE 'id(row)' END || ':' || CASE WHEN count(DISTINCT col) >= 2 THEN 'ar1(col)' ELSE 'id(col)' END AS structure FROM c GROUP BY zone""",
    ("cloud",),
)
def adaptive_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "cloud").select(F.col("pass").alias("zone"), F.floor(F.col("y") / 100).alias("row"), F.floor(F.col("x") / 12).alias("col"))
    return zones.adaptive_residual(c)


def _trial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three small lattices with a treatment by column band and a measured response."""
    c = view(spark, sf_dir, "cloud_banded").withColumn("trial", F.col("pass") % 3)
    g = c.groupBy("trial", (F.floor(F.col("y") / 12) + 1).cast("int").alias("row"), (F.floor(F.col("x") / 20) + 1).cast("int").alias("col"), "treat").agg(F.avg("yield").alias("yield"), F.avg("speed").alias("speed"))
    w = Window.partitionBy("trial", "row", "col").orderBy("treat")
    return g.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


@register()
def fit_ofe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.fit_trials(_trial_cells(spark, sf_dir), "trial", "yield ~ treat + speed")


PLAIN = "~ id(row):id(col)"
TRIALS = """+
g AS (SELECT pass % 3 AS trial, CAST(floor(y / 12) + 1 AS INTEGER) AS row, CAST(floor(x / 20) + 1 AS INTEGER) AS col, treat, avg(yield) AS yield, avg(speed) AS speed FROM cloud_banded GROUP BY 1, 2, 3, 4),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial, row, col ORDER BY treat) AS k FROM g) WHERE k = 1),
t AS (SELECT trial, treat, count(*) AS n, avg(yield) AS m, sum(yield * yield) - sum(yield) ** 2 / count(*) AS ss FROM k GROUP BY 1, 2),
e AS (SELECT trial, sum(ss) / (sum(n) - count(*)) AS s2, sum(n * m) / sum(n) AS all_m, sum(n) AS all_n, count(*) AS levels FROM t GROUP BY 1)"""


@register()
def ofe_lsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.trial_means(_trial_cells(spark, sf_dir), "trial", "treat", "yield ~ treat", residual=PLAIN)


@register(
    TRIALS + " SELECT t.trial, treat AS level, round(m, 4) AS mean, round(sqrt(s2 / n), 4) AS std_error FROM t JOIN e ON t.trial = e.trial",
    ("cloud_banded",),
)
def ofe_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trials.trial_means(_trial_cells(spark, sf_dir), "trial", "treat", "yield ~ treat", residual=PLAIN)
    return m.select("trial", "level", F.round("mean", 4).alias("mean"), F.round("std_error", 4).alias("std_error"))


@register(
    TRIALS
    + """, w AS (SELECT t.trial, 'treat' AS term, (max(levels) - 1)::BIGINT AS df, sum(n * (m - all_m) ** 2) / max(s2) AS wald FROM t JOIN e ON t.trial = e.trial GROUP BY 1)
SELECT trial, term, df, round(wald, 3) AS wald, round(wald / df, 3) AS f FROM w""",
    ("cloud_banded",),
)
def wald_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trials.trial_wald(_trial_cells(spark, sf_dir), "trial", "yield ~ treat", residual=PLAIN)
    return w.filter("term = 'treat'").select("trial", "term", "df", F.round("wald", 3).alias("wald"), F.round("f", 3).alias("f"))


@register()
def wald_tests_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.trial_wald(_trial_cells(spark, sf_dir), "trial", "yield ~ treat + speed")


@register()
def ofe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.trial_pairs(_trial_cells(spark, sf_dir), "trial", "treat", "yield ~ treat", residual=PLAIN, adjust="tukey")


@register()
def compact_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.letters(trials.trial_pairs(_trial_cells(spark, sf_dir), "trial", "treat", "yield ~ treat", residual=PLAIN), "trial")


@register(
    TRIALS
    + """, a AS (SELECT * FROM t WHERE treat = 'A')
SELECT t.trial, CASE WHEN t.treat = 'A' THEN '(Intercept)' ELSE 'treat' || t.treat END AS term, round(CASE WHEN t.treat = 'A' THEN t.m ELSE t.m - a.m END, 4) AS estimate, round(sqrt(s2 * (1.0 / a.n + CASE WHEN t.treat = 'A' THEN 0 ELSE 1.0 / t.n END)), 4) AS std_error FROM t JOIN e ON t.trial = e.trial JOIN a ON t.trial = a.trial""",
    ("cloud_banded",),
)
def fit_integrated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = trials.fit_integrated(_trial_cells(spark, sf_dir), "trial", "yield", "treat", engine="lm")
    return f.select("trial", "term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


@register()
def fit_integrated_reml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.fit_integrated(_trial_cells(spark, sf_dir), "trial", "yield", "treat", ["speed"])


@register()
def fit_integrated_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.fit_integrated(_trial_cells(spark, sf_dir), "trial", "yield", "treat", ["speed"], engine="exp")


@register()
def compare_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.compare_integration(_trial_cells(spark, sf_dir), "trial", "yield", "treat", ["speed"])


def _cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cores")


@register(
    TRIALS
    + """, s AS (SELECT trial, row, col, avg(core) AS core FROM cores WHERE core IS NOT NULL GROUP BY 1, 2, 3)
SELECT k.trial::BIGINT AS trial, k.row, k.col, k.treat, round(k.yield, 4) AS yield, round(s.core, 4) AS core FROM k LEFT JOIN s ON k.trial = s.trial AND k.row = s.row AND k.col = s.col""",
    ("cloud_banded", "cores"),
)
def joint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = trials.joint_table(_trial_cells(spark, sf_dir), _cores(spark, sf_dir), "core")
    return t.select(F.col("trial").cast("long").alias("trial"), "row", "col", "treat", F.round("yield", 4).alias("yield"), F.round("core", 4).alias("core"))


@register(
    TRIALS + " SELECT c.trial::INT AS trial, count(*) AS n_off FROM cores c LEFT JOIN k ON k.trial = c.trial AND k.row = c.row AND k.col = c.col WHERE core IS NOT NULL AND k.trial IS NULL GROUP BY 1",
    ("cloud_banded", "cores"),
)
def samples_off_the_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.joint_table(_trial_cells(spark, sf_dir), _cores(spark, sf_dir), "core")[1].select(F.col("trial").cast("int").alias("trial"), "n_off")


@register()
def fit_integrated_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = simulate.simulate_ofe_trial(spark, [1, 2], 12, 9, n_point_samples=40).withColumnRenamed("seed", "trial")
    return trials.fit_integrated_joint(sim.drop("point_true", "point_obs"), sim.select("trial", "row", "col", "point_obs"), "dense_response", "point_obs", residual="id")


@register()
def partition_paddock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.partition_paddock(_trial_cells(spark, sf_dir), "trial", ["yield", "speed"], "skater", min_r2=0.0)


@register()
def paddock_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.paddock_zones(_trial_cells(spark, sf_dir), "trial", ["yield", "speed"], "rectangle", "treat", k=2)


@register()
def paddock_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.paddock_criteria(_trial_cells(spark, sf_dir), "trial", ["yield", "speed"], "kmeans", criterion="ch")


PROFILE = {"max_zones": 4, "min_width": 2.0, "treat": "treat"}


@register()
def partition_pseudo_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.partition_pseudo_env(_trial_cells(spark, sf_dir), "trial", "yield", "col", **PROFILE)


@register(
    TRIALS
    + """, p AS (SELECT trial, col, count(*) AS n FROM k WHERE yield IS NOT NULL AND treat IS NOT NULL GROUP BY 1, 2),
d AS (SELECT trial, col, n, col - lag(col) OVER (PARTITION BY trial ORDER BY col) AS gap FROM p),
b AS (SELECT trial, min(col) - median(gap) / 2 AS low, max(col) + median(gap) / 2 AS high FROM d GROUP BY trial),
z AS (SELECT trial, unnest([1, 2, 3])::INT AS zone, low, high FROM b),
q AS (SELECT trial, zone, low + (high - low) * (zone - 1) / 3 AS s, low + (high - low) * zone / 3 AS t FROM z)
SELECT q.trial, zone, round(s, 6) AS start, round(t, 6) AS "end", round(t - s, 6) AS width, coalesce(sum(n), 0)::BIGINT AS n FROM q LEFT JOIN p ON p.trial = q.trial AND p.col > s AND p.col <= t GROUP BY q.trial, zone, s, t""",
    ("cloud_banded",),
)
def pseudo_env_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.pseudo_env_zones(_trial_cells(spark, sf_dir), "trial", "yield", "col", method="equal", n_zones=3, treat="treat").select("trial", "zone", *_r("start", "end", "width"), "n")


@register()
def pseudo_env_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.pseudo_env_choice(_trial_cells(spark, sf_dir), "trial", "yield", "col", **PROFILE)


@register()
def simulate_ofe_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate_ofe_trial(spark, [1, 2])


@register()
def simulate_paddock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate_paddock(spark, [1, 2], n_zones=2, treatments=["N0", "N60", "N120"], zone_effect=[1.0, 0.5])


@register()
def paddock_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.paddock_truth(simulate.simulate_paddock(spark, [1, 2]), ["elevation", "clay"])


@register()
def simulate_yield_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate_yield_monitor(spark, [1], simulate.Harvest(defects=simulate.Defects()))


@register()
def simulate_yield_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate_yield_samples(spark, [1], design="strip_ends")


def _map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_dense_layer(view(spark, sf_dir, "cloud"), "x", "y", "speed", None, 9.0)


@register(
    CELLS.format(view="cloud", w="9.0")
    + f""",
m AS (SELECT row, col, avg(speed) AS value FROM c GROUP BY row, col),
s AS (SELECT max(row) AS rows, max(col) AS cols, min(x0) AS x0, min(y0) AS y0 FROM c),
l AS (SELECT r.row, k.col, x0, y0 FROM s, (SELECT CAST(unnest(range(1, (SELECT rows FROM s) + 1)) AS INTEGER) AS row) r, (SELECT CAST(unnest(range(1, (SELECT cols FROM s) + 1)) AS INTEGER) AS col) k),
v AS (SELECT x0 + (l.col - 1) * 9.0 AS xmin, y0 + (l.row - 1) * 9.0 AS ymin, value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM l LEFT JOIN m USING (row, col))
SELECT xmin, xmin + 9.0 AS xmax, ymin, ymin + 9.0 AS ymax, round(value, 6) AS value, coalesce({ofe_palette("surface", 64)}[least(greatest(ceil((value - lo) / (hi - lo) * 64), 1), 64)::INT], '{MISSING}') AS fill FROM v""",
    ("cloud",),
)
def ofe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.ofe_map(_map_cells(spark, sf_dir), "speed").withColumn("value", F.round("value", 6))


@register(
    CELLS.format(view="cloud", w="9.0")
    + f""",
m AS (SELECT avg(speed) AS value FROM c GROUP BY row, col), r AS (SELECT min(value) AS lo, max(value) AS hi FROM m),
k AS (SELECT unnest(range(64)) AS i, unnest({ofe_palette("surface", 64)}) AS fill)
SELECT i::INT AS place, CAST(NULL AS VARCHAR) AS label, round(lo + (hi - lo) * i / 64, 6) AS low, round(lo + (hi - lo) * (i + 1) / 64, 6) AS high, fill FROM k, r""",
    ("cloud",),
)
def map_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.map_key(_map_cells(spark, sf_dir), "speed").select("place", "label", *_r("low", "high"), "fill")


@register(
    f"""WITH p AS (SELECT i, ['A', 'B', 'C'][i % 3 + 1] AS treat FROM range(12) t(i)),
c AS (SELECT unnest({ofe_palette("treatment", 3)}) AS fill, unnest(['A', 'B', 'C']) AS treat, unnest({["#0b0b0b"] * 3}) AS ink)
SELECT 'plot' AS kind, i * 18.0::DOUBLE AS xmin, (i + 1) * 18.0::DOUBLE AS xmax, 0.0::DOUBLE AS ymin, 198.0::DOUBLE AS ymax, p.treat AS label, fill FROM p JOIN c ON p.treat = c.treat
UNION ALL SELECT 'replicate', r * 54.0, (r + 1) * 54.0, 0.0, 198.0, (r + 1)::VARCHAR, NULL FROM range(4) t(r)"""
)
def draw_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.draw_design(design.make_trial_design(spark, ["A", "B", "C"], 4, randomise=False)).drop("ink")


@register(
    f"""+
z AS (SELECT CAST(floor(y / 9) AS BIGINT) AS row, CAST(floor(x / 12) AS BIGINT) AS col, CAST(min(floor(x / 60)) + 1 AS BIGINT) AS zone FROM cloud GROUP BY 1, 2),
f AS (SELECT unnest({ofe_palette("zone", 4)}) AS fill, unnest({[ink_on(c) for c in ofe_palette("zone", 4)]}) AS ink, unnest([1, 2, 3, 4]) AS zone)
SELECT 'cell' AS kind, col - 0.5::DOUBLE AS xmin, col + 0.5::DOUBLE AS xmax, row - 0.5::DOUBLE AS ymin, row + 0.5::DOUBLE AS ymax, zone::VARCHAR AS label, fill, NULL AS ink FROM z JOIN f USING (zone)
UNION ALL SELECT 'label', median(col), median(col), median(row), median(row), zone::VARCHAR, fill, ink FROM z JOIN f USING (zone) GROUP BY zone, fill, ink""",
    ("cloud",),
)
def draw_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cloud").select(F.floor(F.col("x") / 12).alias("col"), F.floor(F.col("y") / 9).alias("row"), (F.floor(F.col("x") / 60) + 1).alias("zone"))
    return maps.draw_zones(cells.groupBy("row", "col").agg(F.min("zone").alias("zone")))


@register()
def draw_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = design.make_trial_design(spark, ["A", "B"], 2)
    return maps.draw_stations(design.place_count_stations(d), d)


@register(" UNION ALL ".join(f"SELECT {y} AS year, '{a}' AS analysis, {n} AS rounds, {e}::DOUBLE AS median_error, {'NULL' if c is None else c}::DOUBLE AS change, {'NULL' if b is None else b}::DOUBLE AS better_than_none" for y, a, n, e, c, b in published.ROWS))
def known_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published.known_answer(spark)


@register(
    """+
p AS (SELECT id, 140 + x / 1000 AS long, -33 + y / 1000 AS lat FROM points),
q AS (SELECT id, (long - avg(long) OVER ()) * 111320.0 * cos(avg(lat) OVER () * pi() / 180) AS x, (lat - avg(lat) OVER ()) * 110540.0 AS y FROM p),
a AS (SELECT 0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) AS t FROM q),
r AS (SELECT id, x, y, x * cos(t) + y * sin(t) AS along, y * cos(t) - x * sin(t) AS across FROM q, a)
SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(along - min(along) OVER (), 4) AS along, round(across - min(across) OVER (), 4) AS across FROM r""",
    ("points",),
)
def project_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "points").select("id", (140 + F.col("x") / 1000).alias("long"), (-33 + F.col("y") / 1000).alias("lat"))
    t = coordinates.along_and_across(coordinates.project(p))
    return t.select("id", *[F.round(c, 4).alias(c) for c in ("x", "y", "along", "across")])
