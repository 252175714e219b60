"""Session factory with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "ledgerlight", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI mode and adaptive execution; shuffle partitions follow the cores unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(8, 2 * (os.cpu_count() or 4))),
        "spark.ui.enabled": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()
