"""Sessions with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes (shuffle partitions, memory) are the cluster's own business."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, if it isn't installed or shipped (same path on all machines)."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, home]))
