"""Named queries over the driver's tables: one per operator group of the survey.

Each takes ``(spark, sf_dir)`` and returns a DataFrame with flat, aliased
columns (arrays joined to text) so results can be compared with the DuckDB
oracle in ``plans.oracle_queries``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import domains as D
from ..functions import links as L
from ..functions import redact as R
from ..functions import report as G
from ..functions.rows import positioned
from ..functions import signals as T
from ..operators import analytics as OA
from ..operators import domains as OD
from ..operators import lite as OL
from ..sources import intake as S
from ..sources import tables
from ..sources.messages import messages
from .investigate import investigate


def accepted(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return S.split_intake(messages(spark, sf_dir, dealt))[0]


def reports(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Full reports. The events (four narrow columns) are dealt out first: a report costs far more than
    their shuffle, and the scan alone gives a large row group to one task."""
    return investigate(accepted(spark, sf_dir, dealt))


def _mask_counts(col: str) -> list:
    c = F.col(col)
    return [R.mask_count(c, C.EMAIL_MASK).alias("n_email"),
            R.mask_count(c, C.SSN_MASK).alias("n_ssn"),
            R.mask_count(c, C.CARD_MASK).alias("n_card"),
            R.mask_count(c, C.PHONE_MASK).alias("n_phone")]


# --- flagship ------------------------------------------------------------------

def verdict_by_event_type(spark, sf_dir):
    """Minimum slice end to end: messages -> intake -> full report -> verdict mix."""
    rep = reports(spark, sf_dir)
    return (rep.groupBy("event_type", "verdict")
            .agg(F.count(F.lit(1)).alias("n_messages"),
                 F.sum("risk_score").cast("long").alias("sum_score"),
                 F.round(F.avg("risk_score"), 2).alias("avg_score"),
                 F.max("risk_score").alias("max_score"),
                 F.sum(F.size("links")).cast("long").alias("n_links")))


# --- redaction -----------------------------------------------------------------

def message_redaction(spark, sf_dir):
    rep = accepted(spark, sf_dir).withColumn(
        "raw_text", S.message_text("text", "image", "demo_offline"))
    return (rep.withColumn("redacted_text", R.redact_pii("raw_text"))
            .select("msg_id", "redacted_text", *_mask_counts("redacted_text")))


def document_redaction(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return (docs.withColumn("redacted_text", R.redact_pii("text"))
            .select("doc_id", "redacted_text", *_mask_counts("redacted_text")))


def conversation_signals(spark, sf_dir):
    """Redaction + signals over every conversation turn (whole texts)."""
    conv = tables.conversations(spark, sf_dir)
    red = conv.withColumn("redacted_text", R.redact_pii("text"))
    ind = T.add_signal_columns(red, "redacted_text")
    return ind.select("conv_id", "turn", "role",
                      F.size("indicators").alias("n_categories"),
                      T.categories_text(F.col("indicators")).alias("categories"),
                      *_mask_counts("redacted_text"))


# --- links -------------------------------------------------------------------

def message_links(spark, sf_dir):
    src = accepted(spark, sf_dir).withColumn(
        "raw_text", S.message_text("text", "image", "demo_offline"))
    return src.select("msg_id", positioned(L.extract_links("raw_text"), ["original", "domain"]))


def page_links(spark, sf_dir):
    pages = tables.pages(spark, sf_dir)
    return pages.select("page_id", positioned(L.extract_links("html"), ["original", "domain"]))


# --- domains -------------------------------------------------------------------

REPORT_FIELDS = ["domain", "risk_score", "verdict", "indicators", "detected_brands"]
TRACE_FIELDS = ["label", "impact", "source", "severity", "evidence", "calculation"]


def _flat_report(r: str | None = "r") -> list:
    p = f"{r}." if r else ""
    return [F.col(f"{p}risk_score").alias("risk_score"), F.col(f"{p}verdict").alias("verdict"),
            F.array_join(F.col(f"{p}indicators"), " | ").alias("indicators"),
            F.array_join(F.col(f"{p}detected_brands"), ",").alias("detected_brands")]


def domain_dimension(spark, sf_dir):
    """D0 + D12: every distinct domain linked from messages or pages, scored once."""
    links = message_links(spark, sf_dir).select("domain").unionByName(
        page_links(spark, sf_dir).select("domain"))
    dim = OD.domain_dimension(links)
    return dim.select("domain", *_flat_report("report"), "n_links")


def message_domain_reports(spark, sf_dir):
    """D13 (inline): reports attached in link order without a shuffle."""
    rep = reports(spark, sf_dir)
    rows = rep.select("msg_id", positioned(F.col("domain_reports"), REPORT_FIELDS))
    return rows.select("msg_id", "pos", "domain", *_flat_report(None))


def domain_join_back(spark, sf_dir):
    """D13 (join form) + D14: distinct-domain reports joined back to links.

    The links are written once: extraction runs once over the texts, the dimension reads the
    domain column only, and the join splits a hot domain (a bucketed table could not)."""
    path = _sink_path(spark, "links")
    message_links(spark, sf_dir).select("msg_id", "pos", "domain").write.parquet(path)
    links = spark.read.parquet(path)
    per_msg = OD.attach_reports(links, OD.domain_dimension(links.select("domain")))
    return per_msg.select(
        "msg_id",
        F.size("domain_reports").alias("n_reports"),
        F.array_max(F.transform("domain_reports", lambda r: r["risk_score"])).alias("max_score"),
        F.array_join(F.transform("domain_reports", lambda r: F.concat(
            r["domain"], F.lit(" ("), r["risk_score"].cast("string"), F.lit("/100)"))), ", "
        ).alias("domain_scores"),
        F.array_join(D.high_risk_domains(F.col("domain_reports")), ", ").alias("high_domains"))


# --- signals -------------------------------------------------------------------

def message_signals(spark, sf_dir):
    rep = reports(spark, sf_dir)
    return rep.select(
        "msg_id", F.size("indicators").alias("n_categories"),
        T.categories_text(F.col("indicators")).alias("categories"),
        F.array_join(F.transform("indicators", lambda i: i["detail"]), " | ").alias("details"))


def signal_hits_long(spark, sf_dir):
    """One row per (message, category, keyword)."""
    src = accepted(spark, sf_dir).withColumn(
        "raw_text", S.message_text("text", "image", "demo_offline"))
    red = src.withColumn("redacted_text", R.redact_pii("raw_text"))
    hits = T.add_signal_columns(red, "redacted_text")
    return hits.select("msg_id", F.inline(T.hit_rows()))


# --- score ---------------------------------------------------------------------

def risk_scores(spark, sf_dir):
    """K1-K12 in the scan's stage alone, without a shuffle."""
    rep = reports(spark, sf_dir, dealt=False)
    return rep.select(
        "msg_id", "risk_score", "verdict", "confidence", "max_domain_score", "top_domain",
        F.size("indicators").alias("n_categories"), "text_sum",
        F.array_join("breakdown", " | ").alias("breakdown"))


def score_trace(spark, sf_dir):
    rep = reports(spark, sf_dir)
    rows = rep.select("msg_id", positioned(F.col("score_trace"), TRACE_FIELDS))
    return rows.withColumns({
        "tone": G.trace_tone(F.col("severity"), F.col("impact")),
        "bar_width": G.trace_bar_width(F.col("impact")),
        "source_label": F.replace(F.col("source"), F.lit("_"), F.lit(" "))})


# --- plan, note, packet, trace -------------------------------------------------

def safe_plan(spark, sf_dir):
    rep = reports(spark, sf_dir)
    return (rep.select("msg_id", positioned(F.col("safe_steps"), None, "step_no", "step"))
            .select("msg_id", "step_no", "step",
                    G.step_topic(F.col("step")).alias("topic"),
                    G.clean_step(F.col("step")).alias("clean_step")))


def dashboard_steps(spark, sf_dir):
    """G16, dashboard form: the first warning sign and all bold marks removed."""
    rep = reports(spark, sf_dir)
    return (rep.select("msg_id", positioned(F.col("safe_steps"), None, "step_no", "step"))
            .select("msg_id", "step_no", G.dashboard_step(F.col("step")).alias("step")))


def breakdown_topics(spark, sf_dir):
    """G14 for every breakdown line."""
    rep = reports(spark, sf_dir)
    return (rep.select("msg_id", positioned(F.col("breakdown"), None, "pos", "line"))
            .select("msg_id", "pos", "line", G.breakdown_topic(F.col("line")).alias("topic")))


def popup_previews(spark, sf_dir):
    """The popup's headline, summary, first three contributors and next step."""
    return OA.popup_preview(reports(spark, sf_dir))


def analyst_notes(spark, sf_dir):
    rep = reports(spark, sf_dir)
    a = F.col("ai_analysis")
    return rep.select(
        "msg_id", a["provider"].alias("provider"), a["model"].alias("model"),
        a["status"].alias("status"), a["fallback_reason"].alias("fallback_reason"),
        a["executive_summary"].alias("executive_summary"),
        a["recommended_priority"].alias("recommended_priority"),
        F.array_join(F.transform(a["evidence"], lambda e: e["signal"]), " | ").alias("evidence"),
        F.array_join(F.transform(a["evidence"], lambda e: e["severity"]), ",").alias("evidence_severity"),
        F.array_join(a["questions"], " | ").alias("questions"),
        F.array_join(a["next_actions"], " | ").alias("next_actions"))


def case_packets(spark, sf_dir):
    rep = reports(spark, sf_dir)
    return rep.select("msg_id", G.target_brand("indicators").alias("target_brand"),
                      "guard_failed", "report_draft")


def investigation_trace(spark, sf_dir):
    rep = reports(spark, sf_dir)
    return (rep.select("msg_id", positioned(F.col("trace"), ["step", "status", "detail"]))
            .select("msg_id", "pos", "step", "status", "detail",
                    G.step_status_label(F.col("status")).alias("status_label")))


def report_labels(spark, sf_dir):
    rep = reports(spark, sf_dir)
    return rep.select(
        "msg_id",
        G.situation_label(F.col("situation")).alias("situation_label"),
        G.route_label(F.col("ai_analysis")).alias("route_label"),
        G.risk_band(F.col("risk_score")).alias("risk_band"),
        G.priority_band(F.col("ai_analysis.recommended_priority")).alias("priority_band"),
        G.status_line(F.col("verdict"), F.col("risk_score")).alias("status_line"),
        G.short_summary(F.col("verdict"), F.col("risk_score"), F.col("confidence"),
                        F.col("score_trace"), F.col("breakdown"), F.col("safe_steps")).alias("short_summary"),
        G.share_summary(F.col("verdict"), F.col("risk_score"), F.col("confidence"),
                        F.col("situation"), F.col("ai_analysis"), F.col("domain_reports"),
                        F.col("breakdown"), F.col("score_trace"), F.col("safe_steps")).alias("share_summary"),
        G.breakdown_topic(F.get(F.col("breakdown"), 0)).alias("first_breakdown_topic"),
        G.escape_html(F.col("report_draft")).alias("packet_html"))


# --- intake ----------------------------------------------------------------------

def intake_quarantine(spark, sf_dir):
    rejected = S.split_intake(messages(spark, sf_dir))[1]
    return rejected.select("msg_id", "situation", "reject_reason")


def screenshot_texts(spark, sf_dir):
    src = accepted(spark, sf_dir).filter(S.has_image("image"))
    txt = S.message_text("text", "image", "demo_offline")
    return src.select("msg_id", txt.alias("raw_text"), R.ocr_preview(txt).alias("ocr_preview"))


def ocr_texts(spark, sf_dir):
    """S5 with a transcription from outside (every fourth message has one): marker text first, then
    the forced local text, then the transcription, then hint words, then the default."""
    given = F.when(F.col("msg_id") % 4 == 0, F.concat(F.lit("Transcript of "), F.col("msg_id").cast("string"),
                                                      F.lit(": pay at https://ocr-"), F.col("user_id").cast("string"),
                                                      F.lit(".top/now")))
    src = accepted(spark, sf_dir).filter(S.has_image("image")).withColumn("ocr_text", given)
    rep = investigate(src, ocr_text_col="ocr_text")
    return rep.select("msg_id", "raw_text", "risk_score", F.size("links").alias("n_links"))


# --- analytics (A1-A8) -------------------------------------------------------------

def evidence_stats(spark, sf_dir):
    return OA.evidence_stats(reports(spark, sf_dir))


def top_contributors(spark, sf_dir):
    return OA.top_contributors(reports(spark, sf_dir))


def primary_evidence(spark, sf_dir):
    rep = reports(spark, sf_dir)
    return rep.select("msg_id", OA.primary_evidence(F.col("domain_reports"), F.col("indicators"))
                      .alias("primary_evidence"))


def case_records(spark, sf_dir):
    cases = OA.case_records(reports(spark, sf_dir))
    return cases.select("case_id", "msg_id", "user_id", "created_at", "verdict", "risk_score",
                        "confidence", "situation", "ai_route", "domain_count", "indicator_count",
                        "text_preview", "stored_text",
                        F.array_join(F.transform("stored_links", lambda l: l["original"]), ",")
                        .alias("stored_links"))


def recent_cases(spark, sf_dir):
    return OA.recent_cases(OA.case_records(reports(spark, sf_dir)))


def campaigns(spark, sf_dir):
    return OA.campaigns(reports(spark, sf_dir))


def _campaign_days(spark, sf_dir):
    """Partial campaigns of all days, written in two loads of which the second is repeated."""
    from ..sources.sinks import write_campaign_days
    path = _sink_path(spark, "campaign-days")
    days = OA.campaign_days(reports(spark, sf_dir))
    early = F.dayofmonth("day") <= 15
    for load in (early, ~early, ~early):
        write_campaign_days(days.where(load), path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))


def campaigns_by_day(spark, sf_dir):
    """A7 merged from days that were computed one load at a time."""
    return OA.merge_days(_campaign_days(spark, sf_dir))


def campaign_totals(spark, sf_dir):
    return OA.campaign_totals(_campaign_days(spark, sf_dir))


def brand_campaigns(spark, sf_dir):
    return OA.brand_campaigns(reports(spark, sf_dir))


# --- lite triage (Q1-Q9) -----------------------------------------------------------

def lite_triage(spark, sf_dir):
    lite = OL.add_lite_columns(accepted(spark, sf_dir))
    return lite.select(
        "msg_id", "lite_score", "lite_verdict", "lite_brand", "lite_domain", "lite_domain_risk",
        "lite_confidence", "lite_priority",
        F.size("lite_indicators").alias("lite_n_indicators"),
        F.array_join("lite_breakdown", " | ").alias("lite_breakdown"),
        F.array_join("lite_trace_labels", " | ").alias("lite_trace"),
        "lite_redacted", "lite_packet")


def lite_reports(spark, sf_dir):
    """Q6/Q8: the lite report's score trace, fallback note and step trace."""
    lite = OL.add_lite_report(OL.add_lite_columns(accepted(spark, sf_dir)))
    n = F.col("lite_note")
    return lite.select(
        "msg_id",
        F.array_join(F.transform("lite_score_trace", lambda t: F.concat(
            t["label"], F.lit(" +"), t["impact"].cast("string"), F.lit(" "), t["severity"])), " | ").alias("score_trace"),
        F.array_join(F.transform("lite_score_trace", lambda t: t["evidence"]), " | ").alias("trace_evidence"),
        n["executive_summary"].alias("note_summary"),
        n["recommended_priority"].alias("note_priority"),
        F.array_join(F.transform(n["evidence"], lambda e: e["signal"]), " | ").alias("note_evidence"),
        F.array_join(n["next_actions"], " | ").alias("note_actions"),
        F.array_join(F.transform("lite_trace", lambda s: F.concat(s["step"], F.lit(": "), s["detail"])),
                     " | ").alias("steps"))


def browser_overlay(spark, sf_dir):
    """P8 + P15: a browser-side model answer laid over the lite report."""
    from ..operators.notes import browser_answers, overlay_columns
    from ..sources.responses import attempts_from
    acc = accepted(spark, sf_dir)
    lite = OL.add_lite_report(OL.add_lite_columns(acc)).join(
        browser_answers(attempts_from(acc)), "msg_id", "left")
    out = overlay_columns(lite)
    return out.select(
        "msg_id", "overlay_provider", "overlay_model", "overlay_priority", "overlay_summary",
        F.size("overlay_evidence").alias("n_evidence"),
        F.array_join(F.transform("overlay_evidence", lambda e: e["signal"]), " | ").alias("evidence"),
        F.array_join("overlay_actions", " | ").alias("next_actions"),
        F.array_join("overlay_questions", " | ").alias("questions"),
        "overlay_packet", "overlay_step")


def lite_agreement(spark, sf_dir):
    both = OL.add_lite_columns(reports(spark, sf_dir))
    return OL.agreement(both)


def lite_agreement_totals(spark, sf_dir):
    both = OL.add_lite_columns(reports(spark, sf_dir))
    return OL.agreement_totals(both)


def _lite_reports(spark, sf_dir):
    return OL.add_lite_report(OL.add_lite_columns(accepted(spark, sf_dir)))


def lite_domain_records(spark, sf_dir):
    """Q8: the lite report's domain record and transcription."""
    r = F.get("lite_domain_reports", 0)
    return _lite_reports(spark, sf_dir).select(
        "msg_id", F.size("lite_domain_reports").alias("n_records"), r["domain"].alias("domain"),
        F.coalesce(r["risk_score"], F.lit(0)).alias("risk_score"), r["verdict"].alias("verdict"),
        F.array_join(r["indicators"], " | ").alias("indicators"),
        F.array_join(r["detected_brands"], ",").alias("brands"),
        F.col("lite_extracted_text").alias("extracted_text"))


def browser_payloads(spark, sf_dir):
    """Request bodies of the browser variant."""
    from ..operators.notes import browser_payload
    lite = _lite_reports(spark, sf_dir)
    return lite.select("msg_id", browser_payload(lite).alias("payload"))


def browser_reports(spark, sf_dir):
    """P15 as a report: the note's remaining fields and the rewritten trace."""
    from ..operators.notes import browser_answers, overlay_columns
    from ..sources.responses import attempts_from
    acc = accepted(spark, sf_dir)
    lite = OL.add_lite_report(OL.add_lite_columns(acc)).join(
        browser_answers(attempts_from(acc)), "msg_id", "left")
    return overlay_columns(lite).select(
        "msg_id", F.col("overlay_status").alias("status"), F.col("overlay_fallback_used").alias("fallback_used"),
        F.col("overlay_explanation").alias("user_explanation"),
        F.col("overlay_confidence_note").alias("confidence_note"),
        F.array_join("overlay_actions", " | ").alias("safe_steps"),
        F.array_join(F.transform("overlay_trace", lambda s: F.concat(s["step"], F.lit(": "), s["detail"])),
                     " | ").alias("trace"))


# --- SQL surface (U1-U3) ------------------------------------------------------------

def sql_tools(spark, sf_dir):
    """All seven tools called from SQL, by name and alias, with arguments and defaults."""
    from ..functions.tools import register_sql_functions
    register_sql_functions(spark)
    src = accepted(spark, sf_dir).withColumn("raw_text", S.message_text("text", "image", "demo_offline"))
    src.select("msg_id", "raw_text", "situation").createOrReplaceTempView("baitline_messages")
    return spark.sql("""
        WITH cleaned AS (
          SELECT msg_id, situation, raw_text, redact_pii(raw_text) AS redacted_text, extract_links(raw_text) AS links
          FROM baitline_messages),
        read AS (
          SELECT *, detect_social_engineering(redacted_text) AS indicators, fetch_safe_steps('Low', situation) AS steps,
                 inspect_domain_pattern(get(links, 0).domain) AS first_report
          FROM cleaned),
        scored AS (SELECT *, score_risk(array(first_report), indicators) AS score FROM read)
        SELECT msg_id, redacted_text, clean_text_pii(raw_text) = redacted_text AS alias_ok,
               size(links) AS n_links, array_join(transform(get_links(raw_text), l -> l.domain), ',') AS domains,
               steps[0] AS first_step, fetch_safe_steps()[0] AS default_first_step, redact_pii() AS empty_redaction,
               coalesce(analyze_domain(get(links, 0).domain).risk_score, 0) AS first_domain_risk,
               array_join(transform(check_social_engineering(redacted_text), i -> i.category), '|') AS categories,
               CASE WHEN size(links) = 1 THEN score.risk_score ELSE 0 END AS one_link_score,
               CASE WHEN size(links) = 1 THEN risk_verdict(score.risk_score) END AS one_link_verdict,
               assess_risk().risk_score AS default_score, size(assess_risk().score_trace) AS default_trace,
               draft_report(raw_text, redacted_text, 80, indicators, steps) AS draft,
               generate_report_draft() AS default_draft
        FROM scored""")


def sql_tool_rows(spark, sf_dir):
    """The table functions in lateral joins: a row per link with its report, and per signal."""
    from ..functions.tools import register_sql_functions
    register_sql_functions(spark)
    src = accepted(spark, sf_dir).withColumn("raw_text", S.message_text("text", "image", "demo_offline"))
    src.select("msg_id", "raw_text").createOrReplaceTempView("baitline_texts")
    return spark.sql("""
        WITH cleaned AS (SELECT msg_id, redact_pii(raw_text) AS redacted_text FROM baitline_texts)
        SELECT 'link' AS kind, m.msg_id, r.pos, r.domain AS name, cast(r.risk_score AS string) AS detail
        FROM baitline_texts m, LATERAL link_reports(m.raw_text) r
        UNION ALL
        SELECT 'signal', m.msg_id, s.pos, s.category, s.detail
        FROM cleaned m, LATERAL text_signals(m.redacted_text) s""")


# --- streaming (ST1-ST4) -------------------------------------------------------------

def stream_reports(spark, sf_dir):
    from ..streaming import jobs
    out = jobs.run_stream_reports(spark, sf_dir)
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def stream_verdict_windows(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_verdict_windows(spark, sf_dir)


def stream_sliding_windows(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_sliding_windows(spark, sf_dir)


def stream_user_sessions(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_sessions(spark, sf_dir)


def stream_history(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_history(spark, sf_dir).select("user_id", "rank", "msg_id", "verdict", "risk_score")


def stream_dedup(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_dedup(spark, sf_dir)


# --- analyst notes from recorded model answers (P6-P14) ------------------------------

def noted_reports(spark, sf_dir):
    from ..operators.notes import note_inputs
    from ..sources.responses import attempts_from
    acc = accepted(spark, sf_dir)
    return investigate(acc, notes=note_inputs(attempts_from(acc)))


def analyst_notes_live(spark, sf_dir):
    rep = noted_reports(spark, sf_dir)
    a = F.col("ai_analysis")
    return rep.select(
        "msg_id", a["provider"].alias("provider"), a["model"].alias("model"),
        a["status"].alias("status"), a["fallback_reason"].alias("fallback_reason"),
        a["request_id"].alias("request_id"), a["usage"].alias("usage"),
        a["executive_summary"].alias("executive_summary"),
        a["recommended_priority"].alias("recommended_priority"),
        F.size(a["evidence"]).alias("n_evidence"),
        F.array_join(F.transform(a["evidence"], lambda e: e["signal"]), " | ").alias("evidence"),
        F.array_join(F.transform(a["evidence"], lambda e: e["why_it_matters"]), " | ").alias("evidence_why"),
        F.array_join(F.transform(a["evidence"], lambda e: e["severity"]), ",").alias("evidence_severity"),
        F.array_join(a["questions"], " | ").alias("questions"),
        F.array_join(a["next_actions"], " | ").alias("next_actions"),
        F.get(F.col("trace"), F.size("trace") - 3)["detail"].alias("analyst_step"))


def prompt_payloads(spark, sf_dir):
    from ..operators.notes import model_routes, prompt_payload
    rep = reports(spark, sf_dir)
    return rep.select(
        "msg_id",
        prompt_payload(F.col("redacted_text"), F.col("situation"), F.col("verdict"),
                       F.col("risk_score"), F.col("confidence"), F.col("breakdown"),
                       F.col("domain_reports"), F.col("indicators"), F.col("safe_steps")
                       ).alias("payload"),
        F.array_join(model_routes(F.lit(C.MODEL_ROUTES[2])), ",").alias("routes"))


# --- catalogues and sinks (S2-S4, S9-S11, T8 join form) ------------------------------

def _sink_path(spark, name):
    from ..session import work_folder
    return work_folder(spark, "sinks", name)


def sample_matches(spark, sf_dir):
    """S2 + S3: messages carrying a catalogue sample, with the sample's default situation."""
    from ..sources.fixtures import samples
    cat = F.broadcast(samples(spark).withColumnRenamed("situation", "sample_situation")
                      .withColumnRenamed("source", "sample_source"))
    m = messages(spark, sf_dir)
    return (m.join(cat, "text").select(
        "msg_id", F.col("name").alias("sample"), "sample_source",
        F.col("situation").alias("requested_situation"),
        S.sample_situation(F.col("situation"), F.col("sample_situation")).alias("situation")))


def screenshot_fixtures(spark, sf_dir):
    """S4 + S5: screenshots matched to the manifest; of several markers the first in manifest order counts."""
    from ..sources.fixtures import manifest_fields
    rep = reports(spark, sf_dir).filter(F.col("has_image"))
    found = manifest_fields(F.col("image"))
    return rep.select("msg_id", found["id"].alias("fixture_id"),
                      found["expected_verdict"].alias("expected_verdict"), "verdict",
                      (found["expected_verdict"] == F.col("verdict")).alias("agrees"))


def lexicon_hits(spark, sf_dir):
    """T8 for the whole lexicon, brands included: the in-row form, no join with the word list."""
    return signal_hits_long(spark, sf_dir)


def report_exports(spark, sf_dir):
    """One JSON export document per report."""
    from ..sources.sinks import export_json
    rep = reports(spark, sf_dir)
    return rep.select("msg_id", export_json(rep, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
                      .alias("export_json"))


def packet_files(spark, sf_dir):
    """Packets written as JSON lines per verdict and read back."""
    from ..sources.sinks import read_packets, write_packets
    path = _sink_path(spark, "packets")
    write_packets(reports(spark, sf_dir), path)
    return read_packets(spark, path).select("msg_id", "verdict", "packet")


def history_store(spark, sf_dir):
    """S11 with A4's nested report: cases merged in three loads into the keyed store, then the newest per user.

    The case files are written once, so the loads do not repeat the investigation."""
    from ..sources.history import HistoryStore
    path = _sink_path(spark, "cases")
    OA.case_files(reports(spark, sf_dir)).write.option("compression", "zstd").parquet(path)
    cases = spark.read.parquet(path)
    store = HistoryStore(spark, _sink_path(spark, "history"))
    for situation in C.SITUATIONS:
        store.merge(cases.where(F.col("situation") == situation))
    return OA.recent_cases(
        store.read(), C.HISTORY_SIZE, F.col("report.redacted_text").alias("report_text"),
        F.array_join(F.transform("report.links", lambda l: l["original"]), ",").alias("report_links"),
        F.col("report.extracted_text").isNull().alias("no_transcription"),
        F.size("report.score_trace").alias("n_trace"), F.col("report.report_draft").alias("report_draft"))


def export_files(spark, sf_dir):
    """Exports written day by day in two loads, the second one repeated, and read back."""
    from ..sources.sinks import read_exports, write_exports
    path = _sink_path(spark, "exports")
    rep = reports(spark, sf_dir)
    early = F.dayofmonth("ts") <= 15
    for load in (early, ~early, ~early):
        write_exports(rep.where(load), path)
    return read_exports(spark, path).select("day", F.col("value").alias("export_json"))


def request_intake(spark, sf_dir):
    """Messages written as JSON requests, some cut off, scanned with their quarantine;
    the catalogue's samples found in the table are scanned as text files."""
    from ..sources import requests as SR
    path = _sink_path(spark, "requests")
    msgs = messages(spark, sf_dir)
    SR.write_requests(msgs, f"{path}/whole")
    lines = spark.read.text(f"{path}/whole")
    number = F.regexp_extract("value", '"msg_id":([0-9]+)', 1).cast("bigint")
    cut = F.when(number % 17 == 3, F.expr("left(value, length(value) - 5)")).otherwise(F.col("value"))
    lines.select(cut.alias("value")).write.text(f"{path}/json")
    accepted_rows, quarantine = SR.split_requests(SR.read_requests(spark, f"{path}/json"))
    (sample_matches(spark, sf_dir).join(msgs, "msg_id").select("sample", "text").distinct()
     .write.partitionBy("sample").text(f"{path}/texts"))
    texts, blank = SR.split_requests(SR.read_texts(spark, f"{path}/texts/*"))
    of_record = F.regexp_extract("record", '"msg_id":([0-9]+)', 1).cast("bigint")

    def shown(df, kind, msg_id, reason):
        return df.select(F.lit(kind).alias("kind"), msg_id.cast("bigint").alias("msg_id"), "situation", reason.alias("reject_reason"),
                         F.length("text").alias("n_chars"), F.col("source").contains(path.rsplit("/", 1)[1]).alias("has_source"))
    none = F.lit(None).cast("string")
    return (shown(accepted_rows, "json", F.col("msg_id"), none)
            .unionByName(shown(quarantine, "json", F.coalesce("msg_id", of_record), F.col("reject_reason")))
            .unionByName(shown(texts.unionByName(blank, allowMissingColumns=True), "text", F.lit(-1), none)))


def unanswered_messages(spark, sf_dir):
    """Accepted messages for which no model call gave a usable answer."""
    from ..operators.notes import unanswered
    from ..sources.fixtures import situations
    from ..sources.responses import attempts_from
    acc = accepted(spark, sf_dir)
    return unanswered(acc, attempts_from(acc), situations(spark)).select("msg_id", "situation", "demo_offline")


# --- extension intake over real conversation text (S8 -> G5) --------------------------

def conversation_reports(spark, sf_dir):
    """Conversation turns sent as extension selections: trimmed, blanks dropped,
    default situation, then the full investigation over the whole turn text."""
    conv = tables.conversations(spark, sf_dir)
    sel = S.extension_intake(conv.select(
        F.xxhash64("conv_id", "turn").alias("msg_id"), "conv_id", "turn", "text"))
    msgs = sel.withColumns({"image": F.lit(None).cast("string"), "demo_offline": F.lit(False)})
    rep = investigate(msgs)
    return rep.select("conv_id", "turn", "situation", "verdict", "risk_score", "confidence",
                      F.size("links").alias("n_links"), F.size("indicators").alias("n_categories"),
                      T.categories_text(F.col("indicators")).alias("categories"),
                      G.status_line(F.col("verdict"), F.col("risk_score")).alias("status_line"),
                      "guard_failed")


def _text_reports(texts):
    """G5 over whole texts (msg_id, text): everything else at its default."""
    rep = investigate(texts.withColumns({
        "situation": F.lit("before_click"), "image": F.lit(None).cast("string"), "demo_offline": F.lit(False)}))
    return rep.select(
        "msg_id", "verdict", "risk_score", "confidence", "max_domain_score", "top_domain",
        F.size("links").alias("n_links"), T.categories_text(F.col("indicators")).alias("categories"),
        F.array_join("breakdown", " | ").alias("breakdown"),
        F.array_join(F.transform("trace", lambda s: s["detail"]), " | ").alias("trace"),
        "guard_failed", F.md5("report_draft").alias("draft_md5"))


def document_reports(spark, sf_dir):
    """G5 over every whole document."""
    docs = tables.documents(spark, sf_dir)
    return _text_reports(docs.select(F.col("doc_id").alias("msg_id"), "text")).withColumnRenamed("msg_id", "doc_id")


def page_reports(spark, sf_dir):
    """G5 over the whole source of every page."""
    pages = tables.pages(spark, sf_dir)
    return _text_reports(pages.select(F.col("page_id").alias("msg_id"), F.col("html").alias("text"))
                         ).withColumnRenamed("msg_id", "page_id")
