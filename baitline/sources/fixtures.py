"""Fixed catalogues.

These are small by construction (a handful of rows fixed in code or shipped
with the package), so joining them with a broadcast hint is bounded.
"""
from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

MANIFEST = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                        "fixtures", "screenshot_manifest.json")


def samples(spark: SparkSession) -> DataFrame:
    """The named sample messages."""
    return spark.createDataFrame(C.SAMPLES, "name string, source string, situation string, text string")


def situations(spark: SparkSession) -> DataFrame:
    """The known situations (three rows) with their labels."""
    return spark.createDataFrame([(x, C.SITUATION_LABELS.get(x, C.SITUATION_LABEL_DEFAULT)) for x in C.SITUATIONS],
                                 "situation string, label string")


def screenshot_manifest(path: str = MANIFEST) -> list[dict]:
    """The fixtures of the manifest, a handful of rows shipped with the package and
    read on the driver, so executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["fixtures"]


def manifest_fields(image: Column, path: str = MANIFEST) -> Column:
    """``struct<id, expected_verdict>`` of the first fixture whose marker the payload holds."""
    found = F.lit(None).cast("struct<id: string, expected_verdict: string>")
    for row in reversed(screenshot_manifest(path)):
        found = F.when(F.upper(image).contains(row["marker"]), F.struct(
            F.lit(row["id"]).alias("id"), F.lit(row["expected_verdict"]).alias("expected_verdict"))).otherwise(found)
    return found
