"""What the operators share: the shared folder, checkpoints, word rules, components of a graph."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, as bytes.split() without arguments and Spark's trim() both can use them.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) gets one of our own; a cluster is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints/{sc.applicationId}"
        os.makedirs(where.removeprefix("file://"), exist_ok=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where if ":/" in where else f"file://{where}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 128) -> Iterator[None]:
    """For what is computed inside: Arrow batches of few rows, as where a row holds a whole block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_TABLES: dict[str, Callable] = {}


def worker_table(f: Callable) -> Callable:
    """functools.cache for what a worker process keeps from task to task, until other work begins there (lean)."""
    _TABLES[f.__name__] = f = cache(f)
    return f


def _begin(own: str) -> None:
    for name, f in _TABLES.items():
        if name != own:
            f.cache_clear()


def _give_back() -> None:
    """What Arrow's pool and malloc hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(work: Callable, own: str = "") -> Callable:
    """work (batches to batches), for a worker that lives on and serves other stages, beside an executor that needs the memory.

    Worker tables other than `own` are dropped before it, and what is free after it isn't kept.
    """

    @wraps(work)
    def task(batches):
        _begin(own)
        try:
            yield from work(batches)
        finally:
            _give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: A key that one in so many rows has is joined by broadcast; no more keys than this can be so frequent.
MOST_OFTEN = 1000


def join_counted(rows: DataFrame, classes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with the one row that classes has for each value of keys; `n` there says how many of the rows have it (dropped).

    Values that a thousandth of `total` or more of the rows have, MOST_OFTEN of them at most, are sent
    to every task, so no task gets all rows of a frequent one; all others meet by shuffle. total: the
    number of rows or a little more.
    """
    often = F.col("n") * MOST_OFTEN >= total
    hot = classes.filter(often).drop("n").withColumn("_hot", F.lit(True))
    tried = rows.join(F.broadcast(hot), keys, "left")
    rest = tried.filter("_hot is null").select(*rows.columns).join(classes.filter(~often).drop("n"), keys)
    found = tried.filter("_hot").drop("_hot")
    return found.unionByName(rest.select(*found.columns))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps: each is a minimum by node (combined before the
    shuffle) and a join back, where hubs are broadcast (join_counted), and every round ends in a
    checkpoint, so a lost executor costs one round at most. No node's neighbours are ever gathered.
    Rounds grow as the logarithm of the nodes; max_rounds of them without an end is an error.
    Self-loops are allowed; rows with a null are ignored. An empty input gives an empty result.
    """

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        both = e.select("u", "v")
        if large:
            both = both.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        out = join_counted(both, least, ["u"], total)
        if large:
            out = out.filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        else:
            out = out.select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        return out.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()

    raw = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    raw = checkpoint(raw.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    e, before = raw.filter("u <> v"), None
    n = e.count()
    for _ in range(max_rounds):
        e = checkpoint(star(star(e, True, 2 * n), False, 2 * n))  # neither star reads more than 2 n rows
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        n = now[0]
        if now == before or not n:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    least = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = raw.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
