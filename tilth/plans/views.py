"""Trial-like views of the star-schema tables; the same SQL runs in other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLOUD = "SELECT CAST(l_partkey % 240 AS DOUBLE) AS x, CAST(l_suppkey % 108 AS DOUBLE) AS y, l_extendedprice / l_quantity AS yield, l_returnflag AS treat, l_quantity AS speed, l_suppkey % 12 AS pass FROM lineitem"
BANDED = "SELECT x, y, yield, CASE WHEN x < 80 THEN 'A' WHEN x < 160 THEN 'B' ELSE 'C' END AS treat, speed, pass FROM cloud"
TRACK = "SELECT event_id AS seq, user_id AS pass, CAST(event_id % 50 AS DOUBLE) AS x, CAST(event_id % 7 AS DOUBLE) AS y, value AS yield FROM events"
POINTS = "SELECT c_custkey AS id, CAST(c_custkey % 240 AS DOUBLE) AS x, CAST(c_nationkey * 4 AS DOUBLE) AS y, c_acctbal AS value FROM customer"
QUADRATS = "SELECT l_partkey % 24 AS strip, CAST(floor((l_partkey % 24) / 3.0) AS BIGINT) AS block, CAST((l_partkey % 24) % 3 AS VARCHAR(8)) AS treat, l_quantity AS count, CAST(0.25 AS DOUBLE) AS area FROM lineitem"

TRACKS = "SELECT event_id AS seq, user_id AS trial, CAST(event_id % 50 AS DOUBLE) * (CASE WHEN user_id % 2 = 0 THEN 1 ELSE 25 END) AS x, CAST(event_id % 7 AS DOUBLE) AS y, value AS yield FROM events"
SQUARE = "SELECT CAST(event_id % 21 * 5 AS DOUBLE) AS x, CAST(CAST(floor(event_id / 21) AS BIGINT) % 13 * 5 AS DOUBLE) AS y, value AS yield, event_id AS id FROM events"
CORES = "SELECT CAST(c_custkey % 5 AS INT) AS trial, CAST(c_nationkey % 14 + 1 AS INT) AS row, CAST(c_custkey % 15 + 1 AS INT) AS col, c_acctbal AS core FROM customer"

SQL = {"cloud": CLOUD, "cloud_banded": BANDED, "track": TRACK, "points": POINTS, "quadrats": QUADRATS, "tracks": TRACKS, "square": SQUARE, "cores": CORES}
NEEDS = {"cloud": ["lineitem"], "cloud_banded": ["lineitem"], "track": ["events"], "points": ["customer"], "quadrats": ["lineitem"], "tracks": ["events"], "square": ["events"], "cores": ["customer"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir, without registering anything."""
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name]}
    if name == "cloud_banded":
        return spark.sql(BANDED.replace("FROM cloud", f"FROM ({CLOUD.replace('FROM lineitem', 'FROM {lineitem}')}) c"), **args)
    sql = SQL[name]
    for t in args:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **args)


def prefix(*names: str) -> str:
    """A WITH clause that defines the views for other engines."""
    wanted = [n for n in SQL if n in names or (n == "cloud" and "cloud_banded" in names)]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
