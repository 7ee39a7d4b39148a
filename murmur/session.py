"""A session with the settings that the library is tested with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from murmur.storage import local_dir


def session(name: str = "murmur", cores: str | int = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session unless a master is set already. On a cluster, shuffle partitions should be two to three times its cores,
    and MURMUR_CHECKPOINT_DIR, or spark.checkpoint.dir in its own settings, names a folder that all executors share."""
    builder = SparkSession.builder.appName(name)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    if folder := os.environ.get("MURMUR_CHECKPOINT_DIR"):
        settings.setdefault("spark.checkpoint.dir", folder)
    elif "SPARK_MASTER" not in os.environ:
        settings.setdefault("spark.checkpoint.dir", local_dir())
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
