"""Longitude and latitude to metres along and across a field."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.semantics import number, require_columns

# Metres in a degree of longitude at the equator, and in a degree of latitude.
LONGITUDE, LATITUDE = 111320.0, 110540.0


def project(data: DataFrame, lon: str = "long", lat: str = "lat") -> DataFrame:
    """data with x and y, metres east and north of the mean place (equirectangular about the mean latitude); null without a place."""
    require_columns(data, lon, lat)
    a, b = number(lon), number(lat)
    centre = data.filter(a.isNotNull() & b.isNotNull()).agg(F.avg(a).alias("_lon0"), F.avg(b).alias("_lat0"))
    own = data.join(F.broadcast(centre))  # one row
    return own.withColumns({"x": (a - F.col("_lon0")) * LONGITUDE * F.cos(F.col("_lat0") * math.pi / 180), "y": (b - F.col("_lat0")) * LATITUDE}).drop("_lon0", "_lat0")


def along_and_across(data: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """data with `along`, its place on the main axis of all places, and `across` it, both from 0: the axes of the 2 by 2 covariance in closed form."""
    require_columns(data, x, y)
    a, b = number(x), number(y)
    own = data.withColumns({"_a": a, "_b": b})
    turn = own.filter(a.isNotNull() & b.isNotNull()).agg((0.5 * F.atan2(2 * F.covar_samp("_a", "_b"), F.var_samp("_a") - F.var_samp("_b"))).alias("_t"))
    turned = own.join(F.broadcast(turn)).withColumns({"along": F.col("_a") * F.cos("_t") + F.col("_b") * F.sin("_t"), "across": F.col("_b") * F.cos("_t") - F.col("_a") * F.sin("_t")})
    least = turned.agg(F.min("along").alias("_l0"), F.min("across").alias("_c0"))
    return turned.join(F.broadcast(least)).withColumns({"along": F.col("along") - F.col("_l0"), "across": F.col("across") - F.col("_c0")}).drop("_a", "_b", "_t", "_l0", "_c0")
