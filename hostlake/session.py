"""Session settings every job of this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All of these are runtime SQL settings, so they can be applied to a session that already exists.
SETTINGS = {
    # Wall-clock timestamps are stored without a zone; UTC makes epoch arithmetic exact.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Some joins fan out widely from small inputs: do not gather those inputs into one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Static settings: they only take effect on a session that is built here.
STATIC_SETTINGS = {
    # Do not record a Python call site for every column expression; plans here have thousands.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "hostlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**STATIC_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints and working tables, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None)
