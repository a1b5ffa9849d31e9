"""Analyst notes from recorded model answers.

``note_inputs`` reduces the attempts of each message to one row: the first
answer that parses to a JSON object (models in route order, a second try only
after a 429 on the first), or the first three failures. Attempts are reduced
to one row per route by a partial aggregate, so a call recorded many times
collapses before the shuffle; only the winner's text reaches the result and is
parsed. ``investigate(messages, notes=...)`` joins these rows to the raw
messages *before* the narrow report stage (left join on ``msg_id``), and
builds the live note or the deterministic fallback from them.

Answers are read as VARIANT, so a string that looks like a list or an object
stays a string. A JSON null counts as an absent field; an object with the same
key twice is invalid.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import plan as P
from ..functions import report as G
from ..functions.redact import strip_js, strip_ws

#: Follows the text inside a list, so that text after the first JSON value is seen as an error.
END_MARK = "end of answer"


def parse_whole(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else; else null."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{END_MARK}"]')))
    return F.when((F.size(F.try_variant_get(listed, "$", "array<variant>")) == 2)
                  & (F.try_variant_get(listed, "$[1]", "string") == END_MARK),
                  F.try_variant_get(listed, "$[0]", "variant"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def parse_object(text: Column) -> Column:
    """The whole text as JSON, only if that fails first '{' to last '}'; null unless an object."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first),
                   F.substring(text, first, last - first + 1))
    value = F.coalesce(parse_whole(text), parse_whole(inner))
    return F.when(is_object(value), value)


def field(value: Column, key: str, kind: str = "string") -> Column:
    """One field of a parsed object; null when absent, or when ``kind`` does not fit."""
    return F.try_variant_get(value, f"$.{key}", kind)


def strip_fence(text: Column) -> Column:
    """Drop a leading ```json / trailing ``` fence."""
    t = strip_js(text)
    return strip_js(F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?", ""), "```$", ""))


def string_list(raw: Column, limit: int = 3) -> Column:
    """P10: a JSON list -> trimmed non-blank items (first ``limit``); a string -> one item."""
    arr = F.try_variant_get(raw, "$", "array<variant>")
    items = F.transform(arr, lambda x: strip_ws(F.try_variant_get(x, "$", "string")))
    from_list = F.slice(F.filter(items, lambda x: x != ""), 1, limit)
    text = strip_ws(F.try_variant_get(raw, "$", "string"))
    single = F.when(is_string(raw) & (text != ""), F.array(text))
    return F.coalesce(from_list, single, F.array().cast("array<string>"))


def normalize_evidence(raw: Column, verdict: Column) -> Column:
    """First five items; objects keep signal/why/severity, scalars become signals."""
    sev_default = F.lower(verdict)
    items = F.slice(F.try_variant_get(raw, "$", "array<variant>"), 1, 5)

    def norm(x: Column) -> Column:
        is_obj = is_object(x)
        signal = F.when(is_obj, strip_ws(F.coalesce(field(x, "signal"), F.lit(""))))\
            .otherwise(strip_ws(F.try_variant_get(x, "$", "string")))
        why = F.when(is_obj, strip_ws(F.coalesce(field(x, "why_it_matters"), F.lit(""))))\
            .otherwise(F.lit(C.NOTE_WHY_DEFAULT))
        sev = F.when(is_obj, F.lower(strip_ws(F.coalesce(field(x, "severity"), sev_default))))\
            .otherwise(sev_default)
        return F.struct(signal.alias("signal"),
                        F.when(why == "", F.lit(C.NOTE_WHY_DEFAULT)).otherwise(why).alias("why_it_matters"),
                        F.when(sev.isin("low", "medium", "high"), sev).otherwise(sev_default).alias("severity"))
    kept = F.filter(F.transform(items, norm), lambda e: e["signal"] != "")
    return F.coalesce(kept, F.array().cast("array<struct<signal:string,why_it_matters:string,severity:string>>"))


def note_inputs(attempts: DataFrame) -> DataFrame:
    """One row per message: winning answer (parsed) or the failure reason.

    ``response_model`` (the answer's own model id) and ``usage`` are optional
    columns. Of attempts recorded twice the usable one counts, then the smallest.
    """
    c = F.col

    def optional(name: str) -> Column:
        return c(name) if name in attempts.columns else F.lit(None).cast("string")
    ok = c("http_code").eqNullSafe(200) & parse_object(F.coalesce(c("content"), F.lit("{}"))).isNotNull()
    detail = F.substring(F.coalesce(c("error"), F.lit("")), 1, 240)
    # a call that never got an answer (timeout, connection error) has no code
    failure = F.when(c("http_code").isNull(), F.substring(F.coalesce(c("error"), F.lit("no answer")), 1, 240)).when(
        c("http_code") != 200, F.concat(c("http_code").cast("string"), F.lit(": "), detail)).otherwise(
        F.lit("invalid JSON object"))
    call = F.struct(
        (~ok).alias("failed"), (~ok & failure.contains("429")).alias("busy"),
        F.concat(c("model"), F.lit(" -> "), failure).alias("failure"),
        F.coalesce(optional("response_model"), c("model")).alias("model"),
        c("content").alias("content"), c("request_id").alias("request_id"), optional("usage").alias("usage"))
    routes = (attempts.select("msg_id", c("model_rank").alias("rank"), "attempt", call.alias("call"))
              .groupBy("msg_id", "rank")
              .agg(F.min(F.when(c("attempt") == 0, c("call"))).alias("first"),
                   F.min(F.when(c("attempt") == 1, c("call"))).alias("second"))
              .where(c("first").isNotNull())
              .select("msg_id", "rank",
                      F.when(c("first.busy") & c("second").isNotNull(), c("second")).otherwise(c("first")).alias("a"),
                      F.row_number().over(Window.partitionBy("msg_id").orderBy("rank")).alias("k")))
    # without a winner every route failed, so the first three routes are the first three failures
    reduced = routes.groupBy("msg_id").agg(
        F.min_by(F.when(~c("a.failed"), c("a")), F.when(~c("a.failed"), c("rank"))).alias("won"),
        *[F.max(F.when(c("k") == k, c("a.failure"))).alias(f"failure_{k}") for k in (1, 2, 3)])
    return reduced.select(
        "msg_id",
        F.when(c("won").isNotNull(), parse_object(F.coalesce(c("won.content"), F.lit("{}")))).alias("note_obj"),
        c("won.model").alias("note_model"), c("won.request_id").alias("note_request_id"),
        c("won.usage").alias("note_usage"),
        F.when(c("won").isNull(), F.concat(F.lit(C.REASON_ROUTING), F.concat_ws(
            " | ", "failure_1", "failure_2", "failure_3"))).alias("note_failure"))


def live_or_offline(offline: Column, verdict: Column, situation: Column,
                    demo_offline: Column) -> Column:
    """Live note when an answer won, else the deterministic note with the
    right reason (forced offline first, then routing failure, then no answer)."""
    obj = F.col("note_obj")

    def text(key: str) -> Column:
        return strip_ws(F.coalesce(field(obj, key), F.lit("")))
    live = F.struct(
        F.lit("model_route").alias("provider"),
        F.col("note_model").alias("model"),
        F.lit(False).alias("fallback_used"),
        F.lit("live").alias("status"),
        F.lit(None).cast("string").alias("fallback_reason"),
        F.col("note_request_id").alias("request_id"),
        F.col("note_usage").alias("usage"),
        text("executive_summary").alias("executive_summary"),
        text("user_explanation").alias("user_explanation"),
        strip_ws(F.coalesce(field(obj, "recommended_priority"), P.priority("verdict", "situation"))
                 ).alias("recommended_priority"),
        normalize_evidence(field(obj, "evidence", "variant"), verdict).alias("evidence"),
        string_list(field(obj, "questions", "variant")).alias("questions"),
        string_list(field(obj, "next_actions", "variant")).alias("next_actions"),
        text("confidence_note").alias("confidence_note"),
    )
    forced = F.coalesce(demo_offline, F.lit(False))
    with_reason = offline.withField("fallback_reason", F.when(forced, F.lit(C.REASON_OFFLINE))
                                    .when(F.col("note_failure").isNotNull(), F.col("note_failure"))
                                    .otherwise(F.lit(C.REASON_NO_RESPONSE)))
    return F.when(~forced & obj.isNotNull(), live).otherwise(with_reason)


def prompt_payload(redacted: Column, situation: Column, verdict: Column, risk_score: Column,
                   confidence: Column, breakdown: Column, reports: Column, indicators: Column,
                   steps: Column) -> Column:
    """The request body for an external model job, as JSON text."""
    return F.to_json(F.struct(
        F.substring(redacted, 1, C.PROMPT_CHARS).alias("redacted_message"),
        situation.alias("user_situation"),
        F.struct(verdict.alias("verdict"), risk_score.alias("risk_score"),
                 confidence.alias("confidence"), breakdown.alias("breakdown")).alias("risk_summary"),
        reports.alias("domain_reports"),
        indicators.alias("social_engineering_indicators"),
        steps.alias("current_safe_steps"),
        F.lit("The message was PII-redacted locally before this model prompt.").alias("privacy_note")))


def browser_payload(df: DataFrame) -> Column:
    """P6, browser variant: the body over lite-report columns (links by domain only)."""
    c = F.col
    return F.to_json(F.struct(
        G.situation_label(c("situation")).alias("context"), c("lite_verdict").alias("verdict"),
        c("lite_score").alias("risk_score"), c("lite_confidence").alias("confidence"),
        c("lite_redacted").alias("redacted_text"),
        F.transform("lite_links", lambda l: F.struct(l["domain"].alias("domain"))).alias("links"),
        c("lite_domain_reports").alias("domain_reports"),
        c("lite_indicators").alias("social_engineering_indicators"),
        c("lite_score_trace").alias("score_trace"), c("lite_steps").alias("local_next_actions")))


def model_routes(primary: Column) -> Column:
    """The primary model then the fallbacks, order kept, duplicates and blanks dropped."""
    return F.array_distinct(F.filter(
        F.concat(F.array(primary), F.array(*[F.lit(m) for m in C.MODEL_ROUTES])),
        lambda m: m.isNotNull() & (m != "")))


# --- browser overlay (P8, P15) ---------------------------------------------------------

def browser_answers(attempts: DataFrame) -> DataFrame:
    """Per message with a call: the first answered one in route order, ``msg_id, b_model, b_content``
    (null when every call failed)."""
    answered = F.col("http_code").eqNullSafe(200)
    best = attempts.groupBy("msg_id").agg(F.min_by(
        F.when(answered, F.struct("model", "content")),
        F.when(answered, F.struct("model_rank", "attempt"))).alias("b"))
    return best.select("msg_id", F.col("b.model").alias("b_model"), F.col("b.content").alias("b_content"),
                       F.lit(True).alias("b_called"))


def unanswered(messages: DataFrame, attempts: DataFrame, situations: DataFrame) -> DataFrame:
    """The worklist for a model job: messages of a known situation without an answer.

    Membership is a semi join with the situations, "no answer" a null-safe anti join with
    the answered messages: a message without an id stays on the list once per row.
    """
    answered = (note_inputs(attempts).where(F.col("note_model").isNotNull())
                .select(F.col("msg_id").alias("answered_id")))
    known = messages.join(F.broadcast(situations.select("situation")), "situation", "left_semi")
    return known.join(answered, known["msg_id"].eqNullSafe(answered["answered_id"]), "left_anti")


def browser_parse(content: Column) -> Column:
    """Fence stripped, then the whole text or first '{' to last '}'; null counts as ``{}``."""
    return parse_object(strip_fence(content))


def overlay_columns(df: DataFrame) -> DataFrame:
    """P15 over lite-report rows joined with ``browser_answers``: evidence <= 4,
    actions <= 5 (else the steps), questions <= 3, packet and trace rewritten."""
    c = F.col
    # a column of its own: parsed once, whatever number of fields is read
    df = df.withColumn("_answer", browser_parse(c("b_content")))
    has, obj = c("b_model").isNotNull(), c("_answer")

    def js_or(*vals: Column) -> Column:   # JavaScript `a || b`: '' and null are false
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in vals])
    def texts(key: str, limit: int) -> Column:   # null unless a JSON list
        return F.transform(F.slice(field(obj, key, "array<variant>"), 1, limit),
                           lambda x: F.try_variant_get(x, "$", "string"))

    def as_evidence(x: Column) -> Column:   # objects keep their fields, scalars become signals
        return F.struct(F.when(is_object(x), field(x, "signal")).otherwise(F.try_variant_get(x, "$", "string"))
                        .alias("signal"), field(x, "why_it_matters").alias("why_it_matters"),
                        field(x, "severity").alias("severity"))
    note = c("lite_note")
    summary = js_or(field(obj, "executive_summary"), note["executive_summary"])
    local_evidence = F.transform(note["evidence"], lambda e: F.struct(
        e["signal"].alias("signal"), e["why_it_matters"].alias("why_it_matters"), e["severity"].alias("severity")))
    evidence = F.coalesce(F.transform(F.slice(field(obj, "evidence", "array<variant>"), 1, 4), as_evidence),
                          local_evidence)
    answered_actions = texts("next_actions", 5)
    actions = F.when(F.size(answered_actions) > 0, answered_actions).otherwise(c("lite_steps"))
    questions = F.coalesce(texts("questions", 3), note["questions"])
    packet = F.concat_ws("\n", F.replace(c("lite_packet"), F.lit("Analyst route: Browser Demo Fallback"),
                                         F.concat(F.lit("Analyst route: Browser Model ("), c("b_model"), F.lit(")"))),
                         F.lit(""), F.lit("Model summary:"), summary)
    step_text = F.when(has, F.concat(F.lit("Model enrichment completed via browser route ("), c("b_model"), F.lit(").")))\
        .when(c("b_called"), F.lit(C.OVERLAY_FAILED))
    return df.withColumns({
        "overlay_status": F.when(has, F.lit("live")).otherwise(note["status"]),
        "overlay_fallback_used": ~has,
        "overlay_explanation": F.when(has, js_or(field(obj, "user_explanation"), note["user_explanation"])
                                      ).otherwise(note["user_explanation"]),
        "overlay_confidence_note": F.when(has, js_or(field(obj, "confidence_note"), F.lit(C.OVERLAY_CONFIDENCE))
                                          ).otherwise(note["confidence_note"]),
        "overlay_trace": F.transform("lite_trace", lambda s: s.withField("detail", F.when(
            s["step"] == C.STEP_NOTE, F.coalesce(step_text, s["detail"])).otherwise(s["detail"]))),
        "overlay_provider": F.when(has, F.lit("browser_model_route")).otherwise(note["provider"]),
        "overlay_model": F.when(has, c("b_model")).otherwise(note["model"]),
        "overlay_priority": F.when(has, js_or(field(obj, "recommended_priority"), note["recommended_priority"],
                                              F.lit("review"))).otherwise(note["recommended_priority"]),
        "overlay_summary": F.when(has, summary).otherwise(note["executive_summary"]),
        "overlay_evidence": F.when(has, evidence).otherwise(local_evidence),
        "overlay_actions": F.when(has, actions).otherwise(c("lite_steps")),
        "overlay_questions": F.when(has, questions).otherwise(note["questions"]),
        "overlay_packet": F.when(has, packet).otherwise(c("lite_packet")),
        "overlay_step": F.coalesce(step_text, F.lit("Backend unavailable; browser demo fallback explanation attached."))}).drop("_answer")
