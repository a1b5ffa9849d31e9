"""Scans of the driver's parquet tables.

Every read declares the columns it needs, so Catalyst prunes the parquet scan
(``ReadSchema`` shows only those columns) and pushes filters into it.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


# Unique row key of each text table, used where the caller asks for more scan
# tasks. It must be unique per row (conversations: conv_id and turn), so a hot
# group - one conversation holding a third of all turns - is still spread evenly.
KEYS = {"events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"],
        "conversations": ["conv_id", "turn"]}

#: Session setting by which a caller asks for hash-spread scans of the text tables.
SCAN_PARTITIONS = "spark.baitline.scanPartitions"


def spread(df: DataFrame, partitions: int | None, key: list[str]) -> DataFrame:
    """Rows hash-spread by their key over ``partitions`` tasks; None leaves the scan as it is.

    The plan depends on what the caller asks for and never on the number or
    size of the files. On a large input the scan has enough splits: ask for none.
    """
    return df.repartition(partitions, *key) if partitions else df


def deal(df: DataFrame) -> DataFrame:
    """Rows dealt out by a hash of all their columns, before work that costs far more than a shuffle of
    them: a row group is read by one task, however many rows it holds, and so is a file of one group.

    The number of partitions is the session's and given as such: AQE would merge partitions by their
    bytes, which say little about the work on them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    asked = partitions or int(spark.conf.get(SCAN_PARTITIONS, "0")) or None
    return spread(df, asked, KEYS[name]) if name in KEYS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
