"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results must not depend on where they run: time is UTC. Partition counts are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "drillframe", master: str | None = None, shared: str | None = None, **settings: str) -> SparkSession:
    """shared: the folder that driver and executors share, for intermediate tables; needed on a cluster."""
    own = SETTINGS | ({"spark.checkpoint.dir": shared} if shared else {}) | settings
    builder = SparkSession.builder.appName(name).config(map=own)
    return (builder.master(master) if master else builder).getOrCreate()
