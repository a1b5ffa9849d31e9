"""Intake operators (S3, S5-S8): text resolution, validation, quarantine.

All are projections/filters over the message rows; the screenshot marker
lookup is a short CASE over a fixed five-entry table instead of a theta join,
so it stays in the scan stage.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.redact import strip_js
from ..functions.regex import PY_SPACE
from ..functions.rule import case, lit, rule


def fixture_text(image: str) -> str:
    """S5 first step: text of the first marker contained in the upper-cased payload."""
    return case([(f"contains(upper({image}), {lit(k)})", lit(t)) for k, t in C.OCR_TEXTS], "NULL")


def screenshot_text(image: str, demo_offline: str, ocr_text: str = "NULL") -> str:
    """S5 fallback chain: marker text; forced local -> courier text; a supplied
    transcription (the live model's answer, computed outside Spark); hint words
    in the payload -> bank text; else courier text."""
    hinted = " OR ".join(f"contains(lower({image}), {lit(w)})" for w in C.OCR_HINT_WORDS)
    return (f"coalesce({fixture_text(image)}, CASE WHEN coalesce({demo_offline}, false) THEN {lit(C.OCR_DEFAULT_TEXT)} END, "
            f"{ocr_text}, CASE WHEN {hinted} THEN {lit(C.OCR_TEXTS[0][1])} END, {lit(C.OCR_DEFAULT_TEXT)})")


@rule
def has_image(image: str) -> str:
    return f"({image} IS NOT NULL AND {image} != '')"


@rule
def message_text(text: str, image: str, demo_offline: str, ocr_text: str = "NULL") -> str:
    """With an image its transcription replaces the typed text."""
    return (f"CASE WHEN {has_image.sql(image)} THEN {screenshot_text(image, demo_offline, ocr_text)} "
            f"ELSE coalesce({text}, '') END")


def reject_reason(text: Column, image: Column, situation: Column) -> Column:
    """Null when the request is valid."""
    # only blanks: a search that ends at the first other character
    blank = ~F.coalesce(text.rlike(f"[^{PY_SPACE}]"), F.lit(False))
    return (F.when(blank & ~F.coalesce(has_image(image), F.lit(False)),
                   F.lit("Either message text or screenshot image must be provided."))
            .when(~F.coalesce(situation.isin(*C.SITUATIONS), F.lit(False)),
                  F.lit("Invalid situation. Must be one of before_click, clicked_only, compromised"))
            )


def split_intake(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) - two filters over one projection."""
    tagged = messages.withColumn(
        "reject_reason", reject_reason(F.col("text"), F.col("image"), F.col("situation")))
    return (tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.filter(F.col("reject_reason").isNotNull()))


def sample_situation(requested: Column, sample_default: Column) -> Column:
    """S3: the sample's situation unless the caller picked something else."""
    return F.when(requested.isNotNull() & (requested != "before_click"), requested
                  ).otherwise(F.coalesce(sample_default, requested))


def extension_intake(selections: DataFrame, text_col: str = "text",
                     situation_col: str | None = None) -> DataFrame:
    """Trimmed non-empty selections with a default situation."""
    situation = (F.coalesce(F.col(situation_col), F.lit("before_click"))
                 if situation_col else F.lit("before_click"))
    return (selections
            .withColumn(text_col, strip_js(F.col(text_col)))
            .filter(F.length(F.col(text_col)) > 0)
            .withColumn("situation", situation))
