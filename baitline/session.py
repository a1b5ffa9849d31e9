"""Session and shared-folder helpers."""
from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int = 8, app: str = "baitline") -> SparkSession:
    """Local/test session. On a cluster use the session the platform gives you."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g"))
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    It is the one that ``spark.checkpoint.dir`` names; where that is unset (tests), a
    folder in the session's warehouse, which every executor can reach too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


def work_folder(spark: SparkSession, kind: str, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{checkpoint_dir(spark)}/{kind}/{name}-{uuid.uuid4().hex[:12]}"
