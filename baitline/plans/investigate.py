"""The full investigation (G5) as one narrow Spark stage.

message -> intake text -> redact -> links -> per-link domain reports ->
signals -> score -> safe steps -> analyst note -> packet -> guardrail -> trace.

Every step is a column expression over the message row, so the whole report
is computed in the scan's stage: no shuffle, no join, no Python. At 100 TB
the job is scan-bound and scales with the number of input splits; output is
partitioned like the input. Per-message arrays (links, reports, trace) are
bounded by the message's own text.

Optional live analyst answers are attached by ``operators.notes`` with a
left join on ``msg_id`` (the only shuffle, and only when answers exist).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import domains as D
from ..functions import links as L
from ..functions import plan as P
from ..functions import redact as R
from ..functions import report as G
from ..functions import scoring as K
from ..functions import signals as T
from ..functions.rule import lit
from ..sources import intake as S


def analyse(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Core rules over any text column: redaction, links, domain reports,
    signals (on the redacted text) and the score.

    Columns are added one dependency level at a time with ``withColumns`` (each
    ``withColumn`` would re-analyse the whole growing plan)."""
    df = df.withColumns({"redacted_text": R.redact_pii(text), "links": L.extract_links(text)})
    df = df.withColumns({"domain_reports": D.inspect_links("links"), "_low": F.lower("redacted_text")})
    df = df.withColumns(T.signal_hit_columns("_low"))
    df = df.withColumn("indicators", T.indicators_from_columns()).drop("_low", *T.HIT_COLUMNS)
    return K.add_score_columns(df)


def investigate(messages: DataFrame, ocr_text_col: str = "NULL",
                header: str = C.PACKET_HEADER, notes: DataFrame | None = None) -> DataFrame:
    """Full report rows for (validated) messages.

    Expects ``msg_id, text, situation, image, demo_offline``; other columns
    (``ts``, ``user_id``...) are carried through. ``notes`` (from
    ``operators.notes.note_inputs``) attaches live analyst answers: it is
    joined to the raw messages, before the report columns widen the rows.
    """
    if notes is not None:
        messages = messages.join(notes, "msg_id", "left")
    df = messages.withColumns({
        "has_image": F.coalesce(S.has_image("image"), F.lit(False)),
        "raw_text": S.message_text("text", "image", "demo_offline", ocr_text_col),
        "safe_steps": P.safe_steps("situation")})
    df = analyse(df)
    df = df.withColumns({
        "ai_analysis": P.offline_note(P.offline_reason.sql("demo_offline"), "situation", "verdict", "risk_score",
                                      "breakdown", "domain_reports", "indicators", "safe_steps"),
        "_packet": G.case_packet("redacted_text", "risk_score", "indicators", "safe_steps", lit(header))})
    if notes is not None:
        df = _attach_live_notes(df)
    df = df.withColumns({"guard_failed": R.leaks_pii("_packet"), "report_draft": G.guarded_packet("_packet")})
    return finish_trace(df).drop("_packet")


def finish_trace(df: DataFrame) -> DataFrame:
    """(Re)build the investigation trace from the current note and packet."""
    return df.withColumn("trace", G.investigation_trace(
        "has_image", "raw_text", "links", "domain_reports", "indicators", "verdict", "risk_score", "safe_steps",
        "ai_analysis", "guard_failed"))


REPORT_FIELDS = ["redacted_text", "links", "domain_reports", "indicators", "verdict",
                 "risk_score", "confidence", "breakdown", "score_trace", "safe_steps",
                 "ai_analysis", "report_draft", "trace", "extracted_text"]


def report_struct(df: DataFrame) -> Column:
    """The report as one nested struct (same field names as the tool output)."""
    return F.struct(
        F.col("redacted_text"), F.col("links"), F.col("domain_reports"),
        F.col("indicators").alias("social_engineering_indicators"),
        F.col("verdict"), F.col("risk_score"), F.col("confidence"),
        F.col("breakdown"), F.col("score_trace"),
        F.col("safe_steps"), F.col("ai_analysis"), F.col("report_draft"), F.col("trace"),
        F.when(F.col("has_image"), F.col("raw_text")).alias("extracted_text"))


def _attach_live_notes(df: DataFrame) -> DataFrame:
    from ..operators.notes import live_or_offline
    note = live_or_offline(F.col("ai_analysis"), F.col("verdict"), F.col("situation"),
                           F.col("demo_offline"))
    return (df.withColumn("ai_analysis", note)
            .drop("note_obj", "note_model", "note_request_id", "note_usage", "note_failure"))
