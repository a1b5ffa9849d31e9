"""Sinks (S9, S10): JSON report export, case packets, partial campaigns.

All writes go to folders under the shared checkpoint folder (or a caller
path). A retried job leaves one consistent copy: packets overwrite their folder,
exports and campaigns the days they hold. The history (S11) is ``sources.history``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import report as G
from ..plans.investigate import report_struct


def export_json(rep: DataFrame, exported_at: Column | None = None, app: str = "baitline") -> Column:
    """``{exported_at, app, situation, ai_route, report}`` as JSON text."""
    at = exported_at if exported_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    # null fields are written (as JSON.stringify does), not dropped
    return F.to_json(F.struct(
        at.alias("exported_at"), F.lit(app).alias("app"),
        G.situation_label(F.col("situation")).alias("situation"),
        G.route_label(F.col("ai_analysis")).alias("ai_route"),
        report_struct(rep).alias("report")), {"ignoreNullFields": "false"})


def write_exports(rep: DataFrame, path: str) -> None:
    """Export documents as JSON lines in one folder per day of the message.

    Dynamic partition overwrite: a run replaces the days it holds and leaves the others, so
    days can be exported one by one and exported again. Files are gzipped: an export is several
    KB of mostly fixed texts, and a day that is exported again is there twice until it is replaced.
    """
    day = F.date_format("ts", "yyyy-MM-dd")
    (rep.select(day.alias("day"), export_json(rep, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").option("compression", "gzip").text(path))


def read_exports(spark, path: str) -> DataFrame:
    return spark.read.schema("value string, day string").text(path)


def write_campaign_days(days: DataFrame, path: str) -> None:
    """Partial campaigns in one folder per day; a day that is computed again replaces itself."""
    (days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def write_packets(rep: DataFrame, path: str) -> None:
    """(msg_id, packet) as JSON lines, one folder per verdict; JSON escapes whatever a packet holds."""
    (rep.select("msg_id", "verdict", F.col("report_draft").alias("packet"))
     .write.mode("overwrite").partitionBy("verdict").json(path))


def read_packets(spark, path: str) -> DataFrame:
    return spark.read.schema("msg_id bigint, packet string, verdict string").json(path)
