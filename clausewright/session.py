"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "clausewright", **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` wins. Keys are given with underscores for dots."""
    b = SparkSession.builder.appName(app)
    b = b.master(master) if master else b
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
