"""Report projections and labels.

Everything here is a projection over one report row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .links import link_domains_text
from .redact import leaks_pii, ocr_preview, strip_ws
from .regex import JS_SPACE
from .rule import lit, rule
from .scoring import score_verdict


@rule
def target_brand(indicators: str) -> str:
    """G1: detail of the first Brand Impersonation indicator without its prefix."""
    first = f"get(filter({indicators}, i -> i.category = {lit(C.BRAND)}), 0).detail"
    return f"upper(coalesce(replace({first}, 'Claimed source: ', ''), 'Unknown'))"


@rule
def first_safe_move(steps: str) -> str:
    """G2."""
    return f"coalesce(get({steps}, 0), {lit(C.DEFAULT_FIRST_MOVE)})"


@rule
def case_packet(redacted: str, risk_score: str, indicators: str, steps: str, header: str = lit(C.PACKET_HEADER)) -> str:
    """The anonymised case packet text. ``header`` is a SQL operand too."""
    categories = f"array_join(transform({indicators}, i -> i.category), ', ')"
    lines = [
        header,
        f"concat('Risk: ', upper({score_verdict.sql(risk_score)}), ' (', cast({risk_score} AS string), '/100)')",
        f"concat('Target brand: ', {target_brand.sql(indicators)})",
        f"concat('Signals: ', CASE WHEN size({indicators}) > 0 THEN {categories} ELSE {lit(C.PACKET_NO_SIGNALS)} END)",
        lit(C.PACKET_PRIVACY), "''", "'First safe move:'", first_safe_move.sql(steps), "''",
        "'Anonymized suspicious content:'", redacted, "''", "'Requested action:'", lit(C.PACKET_ACTION)]
    return "concat_ws('\\n', " + ", ".join(lines) + ")"


@rule
def guarded_packet(packet: str) -> str:
    """Replace a leaking packet by the fixed error text."""
    return f"CASE WHEN {leaks_pii.sql(packet)} THEN {lit(C.GUARDRAIL_BLOCKED)} ELSE {packet} END"


_NO_STEP = "cast(array() AS array<struct<step: string, status: string, detail: string>>)"


@rule
def investigation_trace(has_image: str, raw_text: str, links: str, reports: str, indicators: str, verdict: str,
                        risk_score: str, steps: str, note: str, guard_failed: str) -> str:
    """9 or 10 completed steps (OCR only with an image, Domain Inspection
    only with links) with the final details."""
    high = f"transform(filter({reports}, r -> r.verdict = 'High'), r -> r.domain)"
    categories = f"array_join(transform({indicators}, i -> i.category), ', ')"

    def either(condition: str, value: str, other: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE {other} END"

    def step(name: str, detail: str, status: str = "'completed'") -> str:
        return f"named_struct('step', {lit(name)}, 'status', {status}, 'detail', {detail})"

    items = [
        (has_image, step(C.STEP_OCR, f"concat({lit(C.DETAIL_OCR)}, '\"', {ocr_preview.sql(raw_text)}, '\"')")),
        (None, step(C.STEP_REDACT, lit(C.DETAIL_REDACT))),
        (None, step(C.STEP_LINKS, either(
            f"size({links}) > 0", f"concat({lit(C.DETAIL_LINKS)}, cast(size({links}) AS string), ' link(s): ', "
                                  f"{link_domains_text(links)})", lit(C.DETAIL_NO_LINKS)))),
        (f"size({links}) > 0", step(C.STEP_DOMAINS, either(
            f"size({high}) > 0", f"concat({lit(C.DETAIL_HIGH_DOMAINS)}, array_join({high}, ', '))", lit(C.DETAIL_DOMAINS)))),
        (None, step(C.STEP_SIGNALS, either(
            f"size({indicators}) > 0", f"concat({lit(C.DETAIL_SIGNALS)}, cast(size({indicators}) AS string), "
                                       f"' threat signature(s): ', {categories})", lit(C.DETAIL_NO_SIGNALS)))),
        (None, step(C.STEP_SCORE, f"concat({lit(C.DETAIL_SCORE)}, upper({verdict}), ' (', cast({risk_score} AS string), '/100)')")),
        (None, step(C.STEP_PLAN, f"concat({lit(C.DETAIL_PLAN)}, cast(size({steps}) AS string), ' recommendations).')")),
        (None, step(C.STEP_NOTE, either(f"{note}.fallback_used", lit(C.DETAIL_NOTE_OFFLINE),
                                        f"concat({lit(C.DETAIL_NOTE)}, coalesce({note}.model, 'model route'), '.')"))),
        (None, step(C.STEP_PACKET, lit(C.DETAIL_PACKET))),
        (None, step(C.STEP_GUARD, either(guard_failed, lit(C.DETAIL_GUARD_FAILED), lit(C.DETAIL_GUARD)),
                    either(guard_failed, "'error'", "'completed'"))),
    ]
    return "concat(" + ", ".join(f"array({s})" if c is None else either(c, f"array({s})", _NO_STEP) for c, s in items) + ")"


# --- labels -----------------------------------------------------------------

def situation_label(situation: Column) -> Column:
    """G6."""
    expr = F.when(F.lit(False), F.lit(""))
    for sit, label in C.SITUATION_LABELS.items():
        expr = expr.when(situation == sit, F.lit(label))
    return expr.otherwise(F.lit(C.SITUATION_LABEL_DEFAULT))


def route_label(note: Column) -> Column:
    """G7."""
    return (F.when(note.isNull(), "Local Rules")
            .when(note["fallback_used"], "Local Fallback").otherwise("Live Model Analyst"))


def risk_band(score: Column) -> Column:
    """Danger / warning / safe at 70 / 35."""
    return F.when(score >= 70, "danger").when(score >= 35, "warning").otherwise("safe")


def priority_band(priority: Column) -> Column:
    """G9."""
    p = F.lower(F.coalesce(priority, F.lit("")))
    return (F.when(p.isin("lockdown", "urgent", "high"), "danger")
            .when(p.isin("caution", "medium"), "warning").otherwise("safe"))


def trace_tone(severity: Column, impact: Column) -> Column:
    """Severity or impact, whichever is worse."""
    return (F.when((severity == "high") | (impact >= 70), "danger")
            .when((severity == "medium") | (impact >= 35), "warning").otherwise("safe"))


def share_summary(verdict: Column, risk_score: Column, confidence: Column,
                  situation: Column, note: Column, reports: Column, breakdown: Column,
                  trace: Column, steps: Column) -> Column:
    """G11."""
    domains = F.array_join(F.transform(reports, lambda r: F.concat(
        r["domain"], F.lit(" ("), r["risk_score"].cast("string"), F.lit("/100)"))), ", ")
    top = F.array_join(F.transform(F.slice(trace, 1, 3), lambda t: F.concat(
        t["label"], F.lit(" +"), t["impact"].cast("string"))), "; ")
    actions = F.array_join(F.transform(F.slice(steps, 1, 3), lambda s, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.concat_ws(
        "\n",
        F.lit("Risk summary"),
        F.concat(F.lit("Verdict: "), verdict, F.lit(" ("), risk_score.cast("string"),
                 F.lit("/100), confidence "), confidence.cast("string"), F.lit("%")),
        F.concat(F.lit("Context: "), situation_label(situation)),
        F.concat(F.lit("AI analyst: "), route_label(note)),
        F.concat(F.lit("Domains: "), F.when(F.size(reports) > 0, domains).otherwise(F.lit("none"))),
        F.concat(F.lit("Signals: "), F.array_join(breakdown, "; ")),
        F.concat(F.lit("Score trace: "),
                 F.when(F.size(trace) > 0, top).otherwise(F.array_join(breakdown, "; "))),
        F.lit(""),
        F.lit("Recommended next actions:"),
        F.when(F.size(steps) > 0, actions).otherwise(F.lit("No actions generated.")),
    )


def short_summary(verdict: Column, risk_score: Column, confidence: Column,
                  trace: Column, breakdown: Column, steps: Column) -> Column:
    """Four lines with a coalesced top signal."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Verdict: "), verdict, F.lit(" ("), risk_score.cast("string"), F.lit("/100)")),
        F.concat(F.lit("Confidence: "), confidence.cast("string"), F.lit("%")),
        F.concat(F.lit("Top signal: "), F.coalesce(
            F.nullif(F.get(trace, 0)["label"], F.lit("")),
            F.nullif(F.get(breakdown, 0), F.lit("")), F.lit("review needed"))),
        F.concat(F.lit("Action: "), F.coalesce(
            F.nullif(F.get(steps, 0), F.lit("")),
            F.lit("Use official channels before interacting."))),
    )


def status_line(verdict: Column, risk_score: Column) -> Column:
    """G13."""
    return F.format_string("%s (%d/100)", verdict, risk_score)


def breakdown_topic(line: Column) -> Column:
    """First matching topic of a breakdown line."""
    t = F.lower(line)
    return (F.when(t.contains("link") | t.contains("destination"), "link")
            .when(t.contains("urgency") | t.contains("threat"), "urgency")
            .when(t.contains("impersonate") | t.contains("trusted"), "brand")
            .when(t.contains("payment") | t.contains("bank") | t.contains("fee"), "payment")
            .when(t.contains("credential") | t.contains("code") | t.contains("data"), "credential")
            .otherwise("warning"))


def step_topic(step: Column) -> Column:
    """First matching topic of a safe step."""
    t = F.lower(step)
    return (F.when(t.contains("do not click") | t.contains("danger") | t.contains("not reply"), "stop")
            .when(t.contains("verify") | t.contains("check"), "verify")
            .when(t.contains("report") | t.contains("delete") | t.contains("block"), "report")
            .when(t.contains("bank") | t.contains("card") | t.contains("freeze"), "bank")
            .when(t.contains("password") | t.contains("credential") | t.contains("mfa")
                  | t.contains("2fa"), "password")
            .otherwise("done"))


def clean_step(step: Column) -> Column:
    """G16: '**' and display symbols removed, whitespace trimmed."""
    out = F.replace(step, F.lit("**"), F.lit(""))
    for sym in C.STEP_SYMBOLS:
        out = F.replace(out, F.lit(sym), F.lit(""))
    return strip_ws(out)


def dashboard_step(step: Column) -> Column:
    """G16, dashboard form: the first of its four signs is dropped (the warning sign at the
    start only) with the blanks after it, then all '**'."""
    start, *anywhere = C.DASHBOARD_SIGNS
    blanks = f"[{JS_SPACE}]*"
    signs = "|".join(anywhere)
    once = F.regexp_replace(step, f"(?s)^(?:{start}{blanks}|(.*?)(?:{signs}){blanks})", "$1")
    return F.replace(once, F.lit("**"), F.lit(""))


def step_status_label(status: Column) -> Column:
    """G17."""
    return (F.when(status == "completed", "DONE").when(status == "running", "RUN")
            .otherwise("WAIT"))


def escape_html(text: Column) -> Column:
    """Five characters, '&' first."""
    out = F.coalesce(text, F.lit(""))
    for ch, ent in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]:
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def trace_bar_width(impact: Column) -> Column:
    """Display width clamped to 4..100."""
    return F.least(F.greatest(impact, F.lit(4)), F.lit(100))


def sanitize_for_history(redacted: Column, links: Column) -> tuple[Column, Column]:
    """Stored text defaults to the screenshot placeholder; links keep only the domain."""
    stored = F.coalesce(F.nullif(redacted, F.lit("")), F.lit(C.SCREENSHOT_TEXT_MASK))
    safe_links = F.transform(links, lambda l: F.struct(
        l["domain"].alias("domain"), l["domain"].alias("original")))
    return stored, safe_links
