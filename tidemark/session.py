"""Session helpers: a UTC, adaptive SparkSession and typed access to the fixture tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the settings that every plan of this package assumes.

    Only settings that decide *results* (time zone) or let Catalyst re-plan at run time are set;
    sizes such as the number of shuffle partitions stay the cluster's own unless given in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table; a folder or a file, in any store that Spark's readers open."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
