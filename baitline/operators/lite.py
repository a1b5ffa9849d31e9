"""Lite triage (Q1-Q9): the second, cheaper rule set, as column expressions.

It is a separate scorer with its own results, not an approximation of the
full one; ``agreement`` compares the two verdicts per message.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import links as L
from ..functions import redact as R
from ..functions.rule import let, texts
from ..functions.scoring import score_verdict


def fixture_text(marker: Column) -> Column:
    """Q1: browser fixture text by marker word, else ''."""
    up = F.upper(F.coalesce(marker, F.lit("")))
    expr = F.when(F.lit(False), F.lit(""))
    for key, text in C.LITE_FIXTURE_TEXTS:
        expr = expr.when(up.contains(key), F.lit(text))
    return expr.otherwise(F.lit(""))


def source_text(text: Column, marker: Column) -> Column:
    """Q1: typed text, else fixture text, else the default sentence; trimmed."""
    return R.strip_js(F.coalesce(F.nullif(text, F.lit("")), F.nullif(fixture_text(marker), F.lit("")),
                                 F.lit(C.LITE_DEFAULT_TEXT)))


def safe_steps(situation: Column) -> Column:
    """Q7."""
    expr = F.when(F.lit(False), F.array())
    for sit, steps in C.LITE_SAFE_STEPS.items():
        expr = expr.when(situation == sit, F.array(*[F.lit(s) for s in steps]))
    return expr.otherwise(F.array(*[F.lit(s) for s in C.SAFE_STEPS["before_click"]]))


def _says(pattern: str) -> Column:
    """Whether the lower-cased ``lite_text`` matches a pattern of plain words: a substring test a word,
    up to the first that holds (a pattern tries every word at every place)."""
    words = pattern.replace(r"\$", "$").split("|")
    return F.expr(let("low", "lower(lite_text)", f"exists({texts(words)}, w -> contains(low, w))"))


def add_lite_columns(df: DataFrame, text: str = "text", marker: str = "image",
                     situation: str = "situation") -> DataFrame:
    """Q1-Q8 as columns prefixed ``lite_``."""
    df = df.withColumn("lite_text", source_text(F.col(text), F.col(marker)))
    low = F.lower(F.col("lite_text"))
    df = df.withColumns({
        "lite_redacted": R.redact_lite(F.col("lite_text")),
        "lite_links": L.lite_links(F.col("lite_text")),
        "_dhl": low.contains("dhl"),
        "_paypal": low.contains("paypal"),
        "_fedex": low.contains("fedex"),
        "_prize": low.contains("prize") | low.contains("rewards") | low.contains("lottery"),
        "_qr": low.contains("qr") | low.contains("microsoft"),
        "_pay": _says(C.LITE_PAYMENT_PATTERN),
        "_data": _says(C.LITE_DATA_PATTERN),
        "_urg": _says(C.LITE_URGENCY_PATTERN)})
    c = F.col
    brand = (F.when(c("_dhl"), "DHL").when(c("_paypal"), "PAYPAL").when(c("_fedex"), "FEDEX")
             .when(c("_qr"), "MICROSOFT").when(c("_prize"), "GOOGLE").otherwise("UNKNOWN"))
    df = df.withColumns({"lite_brand": brand, "lite_domain": L.first_domain(F.col("lite_links"))})
    has_domain, has_brand = c("lite_domain") != "", c("lite_brand") != "UNKNOWN"

    def pts(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)
    score = 52 + pts(has_domain, 18) + pts(has_brand, 16) + pts(c("_pay"), 12) \
        + pts(c("_data"), 12) + pts(c("_urg"), 8)
    score = F.when(c("_dhl"), F.lit(95)).otherwise(score)
    for flag, floor in [("_paypal", 74), ("_fedex", 86), ("_prize", 82), ("_qr", 72)]:
        score = F.when(c(flag), F.greatest(score, F.lit(floor))).otherwise(score)
    df = df.withColumn("lite_score", F.least(score, F.lit(96)).cast("int"))
    s = c("lite_score")
    risky_end = F.lit(False)
    for end in C.LITE_RISKY_ENDINGS:
        risky_end = risky_end | c("lite_domain").contains(end)
    df = df.withColumns({
        "lite_verdict": F.when(s >= 70, "High").when(s >= 35, "Medium").otherwise("Low"),
        "lite_domain_risk": F.when(has_domain, F.least(
            F.lit(100), s + F.when(risky_end, 5).otherwise(0))).otherwise(0).cast("int"),
        "lite_confidence": F.when(F.coalesce(c(marker), F.lit("")) != "", 92).otherwise(90),
        "lite_priority": F.when(s >= 70, "urgent").otherwise("review"),
        "lite_breakdown": F.array(
            F.when(has_domain, F.lit(C.LITE_LINK_LINES[0]))
            .otherwise(F.lit(C.LITE_LINK_LINES[1])),
            F.when(has_brand, F.lit(C.LITE_BRAND_LINES[0]))
            .otherwise(F.lit(C.LITE_BRAND_LINES[1])),
            F.when(c("_pay"), F.lit(C.LITE_ASK_LINES[0]))
            .when(c("_data"), F.lit(C.LITE_ASK_LINES[1]))
            .otherwise(F.lit(C.LITE_ASK_LINES[2]))),
        "lite_indicators": F.array_compact(F.array(
            F.when(has_brand, F.struct(F.lit(C.BRAND).alias("category"), F.concat(
                F.lit(C.LITE_BRAND_DETAIL[0]), c("lite_brand"),
                F.lit(C.LITE_BRAND_DETAIL[1])).alias("detail"))),
            F.when(c("_pay"), F.struct(F.lit(C.FINANCIAL).alias("category"), F.lit(C.LITE_PAYMENT_DETAIL).alias("detail"))),
            F.when(c("_data"), F.struct(F.lit(C.DATA).alias("category"), F.lit(C.LITE_DATA_DETAIL).alias("detail"))),
            F.when(c("_urg"), F.struct(F.lit("Urgency Pressure").alias("category"), F.lit(C.LITE_URGENCY_DETAIL).alias("detail"))))),
        "lite_trace_labels": F.slice(F.array_compact(F.array(
            F.when(has_domain, F.lit(C.LITE_TRACE_LABELS[0])),
            F.when(has_brand, F.lit(C.LITE_TRACE_LABELS[1])),
            F.when(c("_pay"), F.lit(C.LITE_TRACE_LABELS[2])),
            F.when(c("_data"), F.lit(C.LITE_TRACE_LABELS[3])))), 1, 4),
        "lite_steps": safe_steps(c(situation))})
    packet = F.concat_ws(
        "\n", F.lit(C.PACKET_HEADER),
        F.concat(F.lit("Risk: "), F.upper(c("lite_verdict")), F.lit(" ("), s.cast("string"), F.lit("/100)")),
        F.concat(F.lit("Target brand: "), c("lite_brand")),
        F.concat(F.lit("Signals: "), F.array_join(c("lite_breakdown"), ", ")),
        F.lit(C.PACKET_PRIVACY), F.lit(""), F.lit("First safe move:"), F.get(c("lite_steps"), 0),
        F.lit(""), F.lit("Anonymized suspicious content:"), c("lite_redacted"), F.lit(""),
        F.lit("Analyst route: Browser Demo Fallback"))
    df = df.withColumn("lite_packet", packet)
    return df.drop("_dhl", "_paypal", "_fedex", "_prize", "_qr", "_pay", "_data", "_urg")


def _item(label, impact, source, severity, evidence, calculation) -> Column:
    return F.struct(F.lit(label).alias("label"), impact.cast("int").alias("impact"),
                    F.lit(source).alias("source"), severity.alias("severity"),
                    evidence.alias("evidence"), F.lit(calculation).alias("calculation"))


def add_lite_report(df: DataFrame, marker: str = "image") -> DataFrame:
    """Q6/Q8: lite score trace (<= 4 items), fallback note, the 8-step trace, the domain record and the transcription."""
    c = F.col
    has_domain, has_brand = c("lite_domain") != "", c("lite_brand") != "UNKNOWN"
    low = F.lower(c("lite_text"))
    pay, data = low.rlike(C.LITE_PAYMENT_PATTERN), low.rlike(C.LITE_DATA_PATTERN)
    risk = c("lite_domain_risk")
    trace = F.slice(F.array_compact(F.array(
        F.when(has_domain, _item(C.LITE_TRACE_LABELS[0], risk, "client_demo_domain_pattern",
                                 F.when(risk >= 70, "high").otherwise("medium"),
                                 F.concat(c("lite_domain"), F.lit(": unverified destination in a suspicious message.")),
                                 "demo domain pattern score")),
        F.when(has_brand, _item(C.LITE_TRACE_LABELS[1], F.lit(16), "client_demo_brand_signal", F.lit("medium"),
                                F.concat(F.lit("Message claims to be from "), c("lite_brand"), F.lit(".")),
                                "matched trusted brand signal")),
        F.when(pay, _item(C.LITE_TRACE_LABELS[2], F.lit(12), "client_demo_social_signal", F.lit("medium"),
                          F.lit("Payment, fee, prize, or transfer language detected."), "social engineering hook")),
        F.when(data, _item(C.LITE_TRACE_LABELS[3], F.lit(12), "client_demo_privacy_signal", F.lit("medium"),
                           F.lit("Message asks for verification, login, identity, or credential action."),
                           "credential/data hook")))), 1, 4)
    df = df.withColumn("lite_score_trace", trace)
    image = F.coalesce(c(marker), F.lit("")) != ""
    note = F.struct(
        F.lit("browser-demo").alias("provider"), F.lit("client-demo-fallback").alias("model"),
        F.lit(True).alias("fallback_used"), F.lit("fallback").alias("status"),
        c("lite_priority").alias("recommended_priority"),
        F.concat(F.lit("Classified this as "), c("lite_verdict"), F.lit(" risk ("),
                 c("lite_score").cast("string"), F.lit("/100) using browser demo evidence.")
                 ).alias("executive_summary"),
        F.lit(C.LITE_NOTE_EXPLANATION).alias("user_explanation"),
        F.transform(F.slice(c("lite_score_trace"), 1, 3), lambda t: F.struct(
            t["label"].alias("signal"), t["evidence"].alias("why_it_matters"),
            t["severity"].alias("severity"))).alias("evidence"),
        F.array(*[F.lit(x) for x in C.LITE_NOTE_QUESTIONS]).alias("questions"),
        c("lite_steps").alias("next_actions"),
        F.lit(C.LITE_NOTE_CONFIDENCE).alias("confidence_note"),
        F.lit(C.LITE_NOTE_REASON).alias("fallback_reason"))

    def step(name, detail):
        name = F.lit(name) if isinstance(name, str) else name
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(name.alias("step"), F.lit("completed").alias("status"), detail.alias("detail"))
    steps = F.array(
        step(F.when(image, "Screenshot Fixture OCR").otherwise("PII Redaction"),
             F.when(image, "Loaded deterministic screenshot fixture text in browser demo mode.")
             .otherwise("Redacted sensitive values locally for browser demo mode.")),
        step(C.STEP_LINKS, F.when(has_domain, F.concat(F.lit("Found "), c("lite_domain"), F.lit(".")))
             .otherwise(F.lit("No URL extracted."))),
        step(C.STEP_DOMAINS, F.when(has_domain, F.lit("Applied browser demo domain-pattern scoring."))
             .otherwise(F.lit("Skipped domain scoring because no URL was present."))),
        step(C.STEP_SIGNALS, "Matched social-engineering demo signals."),
        step(C.STEP_SCORE, F.concat(F.lit("Assigned "), c("lite_verdict"), F.lit(" risk ("),
                                    c("lite_score").cast("string"), F.lit("/100)."))),
        step(C.STEP_PLAN, "Generated contextual user-safe next steps."),
        step(C.STEP_NOTE, "Backend unavailable; browser demo fallback explanation attached."),
        step(C.STEP_PACKET, "Built a compact client-side demo case packet."))
    domain_report = F.struct(
        c("lite_domain").alias("domain"), risk.alias("risk_score"), score_verdict("lite_domain_risk").alias("verdict"),
        c("lite_breakdown").alias("indicators"),
        F.when(has_brand, F.array(F.lower("lite_brand"))).otherwise(F.array().cast("array<string>"))
        .alias("detected_brands"))
    return df.withColumns({
        "lite_note": note, "lite_trace": steps,
        "lite_domain_reports": F.filter(F.array(domain_report), lambda r: r["domain"] != ""),
        "lite_extracted_text": F.when(image, c("lite_text"))})


def agreement(rep: DataFrame) -> DataFrame:
    """Q9: confusion counts of the full and the lite verdicts."""
    return rep.groupBy(F.col("verdict").alias("full_verdict"),
                       F.col("lite_verdict")).agg(F.count(F.lit(1)).alias("n_messages"))


def agreement_totals(rep: DataFrame) -> DataFrame:
    """Q9 with its margins: the matrix, a total per verdict of either rule set, and over all (CUBE).

    ``level`` tells a margin from a verdict that is null: 0 cell, 1 row total of the full
    verdict, 2 of the lite verdict, 3 all.
    """
    return rep.cube(F.col("verdict").alias("full_verdict"), "lite_verdict").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_messages"),
        F.sum((F.col("verdict") == F.col("lite_verdict")).cast("bigint")).alias("n_agree"))
