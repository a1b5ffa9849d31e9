"""Scans of submitted requests (S1): JSON lines and whole text files, with their quarantine.

JSON is read with a declared schema in PERMISSIVE mode: a line that is no request keeps
its text in ``record`` and goes to the quarantine with the lines that break a rule, so a
load never fails on one bad line and loses none. ``source`` is the file of a row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .intake import reject_reason

#: Fields of a request; ``msg_id`` is optional, ``record`` holds a line that is not JSON.
REQUEST_SCHEMA = ("msg_id BIGINT, text STRING, situation STRING, image STRING, mime_type STRING, "
                  "demo_offline BOOLEAN, record STRING")
NOT_JSON = "The request is not valid JSON."


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON-lines files; fields that are left out get their defaults.

    A request without an id gets the hash of its file and fields. Text of the wrong JSON
    type (a number, an object) is taken as its JSON text.
    """
    rows = (spark.read.schema(REQUEST_SCHEMA).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "record").json(path)
            .withColumn("source", F.col("_metadata.file_path")))
    return rows.withColumns({
        "text": F.coalesce("text", F.lit("")), "demo_offline": F.coalesce("demo_offline", F.lit(False)),
        "msg_id": F.when(F.col("record").isNull(), F.coalesce(
            "msg_id", F.xxhash64("source", "text", "situation", "image")))})


def read_texts(spark: SparkSession, path: str, situation: str = "before_click") -> DataFrame:
    """One message per text file, whole, with the file's name without its ending as ``name``."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    return (spark.read.text(path, wholetext=True)
            .select(F.xxhash64("_metadata.file_path").alias("msg_id"), F.col("value").alias("text"),
                    F.lit(situation).alias("situation"), F.lit(None).cast("string").alias("image"),
                    F.lit(None).cast("string").alias("mime_type"), F.lit(False).alias("demo_offline"),
                    F.lit(None).cast("string").alias("record"), F.col("_metadata.file_path").alias("source"),
                    name.alias("name")))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine): the quarantine has ``reject_reason`` and the raw ``record``."""
    reason = F.when(F.col("record").isNotNull(), F.lit(NOT_JSON)).otherwise(
        reject_reason(F.col("text"), F.col("image"), F.col("situation")))
    tagged = requests.withColumn("reject_reason", reason)
    return (tagged.where("reject_reason IS NULL").drop("reject_reason", "record"),
            tagged.where("reject_reason IS NOT NULL"))


def write_requests(messages: DataFrame, path: str) -> None:
    """Messages as JSON-lines requests; absent fields are left out."""
    (messages.select("msg_id", "text", "situation", "image", "mime_type", "demo_offline")
     .write.mode("overwrite").json(path))
