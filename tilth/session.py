"""A session with the settings that the operators assume."""

from pyspark.sql import SparkSession


def session(app: str = "tilth", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, Arrow; anything in conf (dots as double underscores) wins."""
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    b = SparkSession.builder.appName(app)
    for k, v in (own | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
