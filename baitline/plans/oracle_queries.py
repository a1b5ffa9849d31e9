"""DuckDB SQL per registered query (the correctness oracle)."""
from __future__ import annotations

from .. import constants as C
from .oracle import (base_ctes, domain_report_ctes, link_ctes, packet_sql, q, qlist,
                     redact_sql, reject_sql, screenshot_sql, signal_ctes, strip_sql,
                     target_brand_sql, trace_rows_sql, trim_sql, valid_sql)
from ..functions.regex import JS_SPACE, js_re
from ..sources.messages import view_sql


def _counts(col: str) -> str:
    out = []
    for name, mask in [("n_email", C.EMAIL_MASK), ("n_ssn", C.SSN_MASK),
                       ("n_card", C.CARD_MASK), ("n_phone", C.PHONE_MASK)]:
        out.append(f"CAST((length({col}) - length(replace({col}, {q(mask)}, ''))) / {len(mask)} AS INTEGER) AS {name}")
    return ", ".join(out)


def _steps_topic(col: str) -> str:
    t = f"lower({col})"
    def any_of(words):
        return " OR ".join(f"contains({t}, {q(w)})" for w in words)
    return (f"CASE WHEN {any_of(['do not click', 'danger', 'not reply'])} THEN 'stop' "
            f"WHEN {any_of(['verify', 'check'])} THEN 'verify' "
            f"WHEN {any_of(['report', 'delete', 'block'])} THEN 'report' "
            f"WHEN {any_of(['bank', 'card', 'freeze'])} THEN 'bank' "
            f"WHEN {any_of(['password', 'credential', 'mfa', '2fa'])} THEN 'password' ELSE 'done' END")


def _clean_step(col: str) -> str:
    out = f"replace({col}, '**', '')"
    for sym in C.STEP_SYMBOLS:
        out = f"replace({out}, {q(sym)}, '')"
    return strip_sql(out)


def _sit_label(col: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.SITUATION_LABELS.items())
    return f"CASE {col} {whens} ELSE {q(C.SITUATION_LABEL_DEFAULT)} END"


def _priority(verdict: str, situation: str) -> str:
    return (f"CASE WHEN {situation} = 'compromised' THEN 'lockdown' WHEN {verdict} = 'High' THEN 'urgent' "
            f"WHEN {verdict} = 'Medium' THEN 'caution' ELSE 'monitor' END")


def _trace_text_sql() -> str:
    """Investigation trace rows (msg_id, pos, step, status, detail) from ``rep``."""
    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    prev = "CASE WHEN length(raw_text) > 60 THEN substring(raw_text, 1, 60) || '...' ELSE raw_text END"
    return f"""
pk AS (SELECT *, {packet_sql()} AS pk FROM rep),
it AS (
  SELECT msg_id, 0 AS k, {q(C.STEP_OCR)} AS step, 'completed' AS status,
    'Screenshot transcribed successfully: "' || {prev} || '"' AS detail FROM pk WHERE has_image
  UNION ALL SELECT msg_id, 1, {q(C.STEP_REDACT)}, 'completed',
    'Anonymization completed. Sensitive data replaced with secure placeholders.' FROM pk
  UNION ALL SELECT msg_id, 2, {q(C.STEP_LINKS)}, 'completed',
    CASE WHEN n_reports > 0 THEN 'Extracted ' || CAST(n_reports AS VARCHAR) || ' link(s): ' || array_to_string(domains, ', ')
         ELSE 'No links detected in the message text.' END FROM pk
  UNION ALL SELECT msg_id, 3, {q(C.STEP_DOMAINS)}, 'completed',
    CASE WHEN n_high > 0 THEN 'Threat layout check finished. HIGH-RISK domain pattern found: ' || array_to_string(high_domains, ', ')
         ELSE 'Domain pattern checks completed. No immediate high-risk spoofing layout detected.' END
    FROM pk WHERE n_reports > 0
  UNION ALL SELECT msg_id, 4, {q(C.STEP_SIGNALS)}, 'completed',
    CASE WHEN n > 0 THEN 'Identified ' || CAST(n AS VARCHAR) || ' threat signature(s): '
         || array_to_string(list_transform(indicators, lambda i: i.category), ', ')
         ELSE 'Text analysis completed. No typical social engineering keywords found.' END FROM pk
  UNION ALL SELECT msg_id, 5, {q(C.STEP_SCORE)}, 'completed',
    'Threat synthesis finished. Verdict: ' || upper(verdict) || ' (' || CAST(risk_score AS VARCHAR) || '/100)' FROM pk
  UNION ALL SELECT msg_id, 6, {q(C.STEP_PLAN)}, 'completed',
    'Custom safety steps generated successfully (' || CAST(len(safe_steps) AS VARCHAR) || ' recommendations).' FROM pk
  UNION ALL SELECT msg_id, 7, {q(C.STEP_NOTE)}, 'completed',
    'Model enrichment unavailable. Deterministic explanation attached.' FROM pk
  UNION ALL SELECT msg_id, 8, {q(C.STEP_PACKET)}, 'completed', 'Authority report draft compiled.' FROM pk
  UNION ALL SELECT msg_id, 9, {q(C.STEP_GUARD)},
    CASE WHEN {guard} THEN 'error' ELSE 'completed' END,
    CASE WHEN {guard} THEN 'Guardrail check FAILED: Raw PII detected in output. Halting.'
         ELSE 'Guardrail check PASSED. Report is safe to present to the user.' END FROM pk
)"""


def oracle_queries() -> dict[str, str]:
    base = base_ctes()
    out: dict[str, str] = {}

    out["verdict_by_event_type"] = f"""{base}
SELECT event_type, verdict, count(*) AS n_messages, CAST(sum(risk_score) AS BIGINT) AS sum_score,
  round(avg(risk_score), 2) AS avg_score, max(risk_score) AS max_score,
  CAST(sum(n_reports) AS BIGINT) AS n_links
FROM rep GROUP BY event_type, verdict"""

    out["message_redaction"] = f"""{base}
SELECT msg_id, redacted_text, {_counts('redacted_text')} FROM red"""

    out["document_redaction"] = f"""
SELECT doc_id, redacted_text, {_counts('redacted_text')}
FROM (SELECT doc_id, {redact_sql('text')} AS redacted_text FROM documents)"""

    out["conversation_signals"] = f"""WITH cv AS (
  SELECT conv_id, turn, role, {redact_sql('text')} AS redacted_text FROM conversations
),
{signal_ctes('c', 'cv', 'conv_id, turn', 'redacted_text')}
SELECT cv.conv_id, cv.turn, cv.role, CAST(len(indicators) AS INTEGER) AS n_categories,
  array_to_string(list_transform(indicators, lambda i: i.category), '|') AS categories,
  {_counts('redacted_text')}
FROM cv JOIN c_sg USING (conv_id, turn)"""

    out["message_links"] = f"""{base}
SELECT msg_id, pos, original, domain FROM m_lk"""

    out["page_links"] = f"""WITH {link_ctes('p', 'pages', 'page_id', 'html')}
SELECT page_id, pos, original, domain FROM p_lk"""

    out["domain_dimension"] = f"""{base},
{link_ctes('p', 'pages', 'page_id', 'html')},
alld AS (SELECT domain, count(*) AS n_links FROM (
  SELECT domain FROM m_lk UNION ALL SELECT domain FROM p_lk) GROUP BY domain),
{domain_report_ctes('x', 'alld')}
SELECT domain, risk_score, verdict, array_to_string(indicators, ' | ') AS indicators,
  array_to_string(detected_brands, ',') AS detected_brands, n_links
FROM x_dr"""

    out["message_domain_reports"] = f"""{base}
SELECT msg_id, pos, domain, risk_score, verdict, array_to_string(indicators, ' | ') AS indicators,
  array_to_string(detected_brands, ',') AS detected_brands
FROM m_dr"""

    out["domain_join_back"] = f"""{base}
SELECT msg_id, CAST(n_reports AS INTEGER) AS n_reports, max_score,
  array_to_string(domain_scores, ', ') AS domain_scores,
  coalesce(array_to_string(high_domains, ', '), '') AS high_domains
FROM dagg"""

    out["message_signals"] = f"""{base}
SELECT msg_id, CAST(n AS INTEGER) AS n_categories,
  array_to_string(list_transform(indicators, lambda i: i.category), '|') AS categories,
  array_to_string(list_transform(indicators, lambda i: i.detail), ' | ') AS details
FROM rep"""

    cats = [("h_urg", C.URGENCY), ("h_brand", C.BRAND), ("h_fin", C.FINANCIAL),
            ("h_data", C.DATA), ("h_rel", C.RELATIONSHIP)]
    unions = "\nUNION ALL\n".join(
        f"SELECT msg_id, {q(cat)} AS category, CAST(generate_subscripts({h}, 1) AS INTEGER) AS rank, "
        f"unnest({h}) AS keyword FROM s_sg" for h, cat in cats)
    out["signal_hits_long"] = f"""{base}
{unions}"""

    out["risk_scores"] = f"""{base}
SELECT msg_id, risk_score, verdict, confidence, CAST(m AS INTEGER) AS max_domain_score,
  CASE WHEN m > 0 THEN top_domain END AS top_domain, CAST(n AS INTEGER) AS n_categories,
  CAST(text_sum AS INTEGER) AS text_sum, array_to_string(breakdown, ' | ') AS breakdown
FROM rep"""

    out["score_trace"] = f"""{base},
{trace_rows_sql()}
SELECT msg_id, pos, label, CAST(impact AS INTEGER) AS impact, source, severity, evidence, calculation,
  CASE WHEN severity = 'high' OR impact >= 70 THEN 'danger'
       WHEN severity = 'medium' OR impact >= 35 THEN 'warning' ELSE 'safe' END AS tone,
  CAST(least(greatest(impact, 4), 100) AS INTEGER) AS bar_width, replace(source, '_', ' ') AS source_label
FROM trp"""

    out["safe_plan"] = f"""{base}
SELECT msg_id, CAST(generate_subscripts(safe_steps, 1) AS INTEGER) AS step_no, unnest(safe_steps) AS step
FROM rep"""
    out["safe_plan"] = f"""{base},
sp AS ({out['safe_plan'].split(base, 1)[1].strip()})
SELECT msg_id, step_no, step, {_steps_topic('step')} AS topic, {_clean_step('step')} AS clean_step FROM sp"""

    why = q(C.NOTE_WHY_RULE)
    out["analyst_notes"] = f"""{base}
SELECT msg_id, {q(C.NOTE_PROVIDER)} AS provider, {q(C.NOTE_MODEL)} AS model, 'fallback' AS status,
  fallback_reason,
  'Classified this as ' || verdict || ' risk (' || CAST(risk_score AS VARCHAR) || '/100) using local rules.' AS executive_summary,
  {_priority('verdict', 'situation')} AS recommended_priority,
  array_to_string(breakdown[1:5], ' | ') AS evidence,
  array_to_string(list_transform(breakdown[1:5], lambda b: lower(verdict)), ',') AS evidence_severity,
  array_to_string(questions[1:3], ' | ') AS questions,
  array_to_string(list_transform(safe_steps[1:3], lambda s: replace(s, '**', '')), ' | ') AS next_actions
FROM rep"""

    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    out["case_packets"] = f"""{base},
pk AS (SELECT *, {packet_sql()} AS pk FROM rep)
SELECT msg_id, {target_brand_sql()} AS target_brand, {guard} AS guard_failed,
  CASE WHEN {guard} THEN {q(C.GUARDRAIL_BLOCKED)} ELSE pk END AS report_draft
FROM pk"""

    out["investigation_trace"] = f"""{base},
{_trace_text_sql().strip()}
SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY k) AS INTEGER) AS pos, step, status, detail,
  CASE status WHEN 'completed' THEN 'DONE' WHEN 'running' THEN 'RUN' ELSE 'WAIT' END AS status_label
FROM it"""

    out["intake_quarantine"] = f"""WITH msgs AS ({view_sql('events')})
SELECT msg_id, situation, {reject_sql()} AS reject_reason FROM msgs WHERE NOT {valid_sql()}"""

    out["screenshot_texts"] = f"""{base}
SELECT msg_id, raw_text,
  CASE WHEN length(raw_text) > 60 THEN substring(raw_text, 1, 60) || '...' ELSE raw_text END AS ocr_preview
FROM rep WHERE has_image"""

    _analytics(out, base)
    _lite(out, base)
    _streams(out, base)
    _notes(out, base)
    _catalogues(out, base)
    _labels(out, base)
    _conversations(out)
    _overlay(out, base)
    _payloads(out, base)
    _exports(out, base)
    _texts(out)
    _intake(out, base)
    draft = packet_sql()
    fixed = "CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END"
    draft_80 = draft.replace(fixed, "'HIGH'").replace("CAST(risk_score AS VARCHAR)", "'80'")
    empty = (f"(SELECT {draft} FROM (SELECT '' AS redacted_text, 0 AS risk_score, []::VARCHAR[] AS safe_steps, "
             "[]::STRUCT(category VARCHAR, detail VARCHAR)[] AS indicators))")
    out["sql_tools"] = f"""{base}
SELECT msg_id, redacted_text, true AS alias_ok, CAST(coalesce(len(domains), 0) AS INTEGER) AS n_links,
  coalesce(array_to_string(domains, ','), '') AS domains, safe_steps[1] AS first_step,
  {q(C.SAFE_STEPS['before_click'][0])} AS default_first_step, '' AS empty_redaction,
  coalesce(f.risk_score, 0) AS first_domain_risk, array_to_string(list_transform(indicators, lambda i: i.category), '|') AS categories,
  CASE WHEN n_reports = 1 THEN rep.risk_score ELSE 0 END AS one_link_score,
  CASE WHEN n_reports = 1 THEN rep.verdict END AS one_link_verdict, 0 AS default_score, 1 AS default_trace,
  {draft_80} AS draft, {empty} AS default_draft
FROM rep LEFT JOIN (SELECT msg_id, risk_score FROM m_dr WHERE pos = 1) f USING (msg_id)"""
    out["sql_tool_rows"] = f"""{base}
SELECT 'link' AS kind, msg_id, pos, domain AS name, CAST(risk_score AS VARCHAR) AS detail FROM m_dr
UNION ALL
SELECT 'signal', msg_id, CAST(generate_subscripts(indicators, 1) AS INTEGER), unnest(indicators).category,
  unnest(indicators).detail FROM rep"""
    return out


def _trace_preview_join() -> str:
    return ("LEFT JOIN (SELECT msg_id, string_agg(label, ' | ' ORDER BY pos) AS trace_preview "
            "FROM trp WHERE pos <= 4 GROUP BY msg_id) tp USING (msg_id)")


def _analytics(out: dict, base: str) -> None:
    status = "verdict || ' (' || CAST(risk_score AS VARCHAR) || '/100)'"
    preview = f"substring(coalesce(nullif(redacted_text, ''), {q(C.SCREENSHOT_TEXT_MASK)}), 1, {C.PREVIEW_CHARS})"
    out["evidence_stats"] = f"""{base},
{trace_rows_sql().strip()}
SELECT msg_id, CAST(n_reports AS INTEGER) AS n_links, CAST(n_high AS INTEGER) AS n_high_domains,
  CAST(m AS INTEGER) AS max_domain_risk, CAST(n AS INTEGER) AS n_hooks,
  CAST(8 + CASE WHEN has_image THEN 1 ELSE 0 END + CASE WHEN n_reports > 0 THEN 1 ELSE 0 END AS INTEGER) AS trace_depth,
  'Local Fallback' AS ai_route, confidence, trace_preview,
  array_to_string(breakdown[1:3], ' | ') AS breakdown_preview
FROM rep {_trace_preview_join()}"""

    out["top_contributors"] = f"""{base},
{trace_rows_sql().strip()}
SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY impact DESC, pos) AS INTEGER) AS rank,
  label, CAST(impact AS INTEGER) AS impact
FROM trp WHERE impact > 0
QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY impact DESC, pos) <= 3"""

    out["primary_evidence"] = f"""{base}
SELECT msg_id, coalesce(top_domain, indicators[1].category, 'No major signal') AS primary_evidence FROM rep"""

    cases = f"""cases AS (
  SELECT 'case-' || substr(md5(CAST(msg_id AS VARCHAR)), 1, 12) AS case_id, msg_id, user_id, ts,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, verdict, risk_score, confidence, situation,
    'Local Fallback' AS ai_route, CAST(n_reports AS INTEGER) AS domain_count,
    CAST(n AS INTEGER) AS indicator_count, {preview} AS text_preview
  FROM rep
)"""
    out["case_records"] = f"""{base},
{cases}
SELECT c.case_id, c.msg_id, c.user_id, c.created_at, c.verdict, c.risk_score, c.confidence, c.situation,
  c.ai_route, c.domain_count, c.indicator_count, c.text_preview,
  coalesce(nullif(r.redacted_text, ''), {q(C.SCREENSHOT_TEXT_MASK)}) AS stored_text,
  coalesce(array_to_string(r.domains, ','), '') AS stored_links
FROM cases c JOIN rep r USING (msg_id)"""

    out["recent_cases"] = f"""{base},
{cases}
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, msg_id DESC) AS INTEGER) AS rank,
  msg_id, case_id, strftime(ts, '%b %-d, %I:%M %p') AS time_label, {status} AS status, text_preview,
  {_sit_label('situation')} AS situation_label, domain_count, indicator_count, ai_route
FROM cases
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, msg_id DESC) <= {C.HISTORY_SIZE}"""

    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    out["history_store"] = f"""{base},
{cases},
{trace_rows_sql().strip()},
pk AS (SELECT msg_id, redacted_text, domains, {packet_sql()} AS pk FROM rep),
nt AS (SELECT msg_id, CAST(count(*) AS INTEGER) AS n_trace FROM trp GROUP BY msg_id)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, msg_id DESC) AS INTEGER) AS rank,
  msg_id, case_id, strftime(ts, '%b %-d, %I:%M %p') AS time_label, {status} AS status, text_preview,
  {_sit_label('situation')} AS situation_label, domain_count, indicator_count, ai_route,
  coalesce(nullif(pk.redacted_text, ''), {q(C.SCREENSHOT_TEXT_MASK)}) AS report_text,
  coalesce(array_to_string(domains, ','), '') AS report_links, true AS no_transcription, n_trace,
  CASE WHEN {guard} THEN {q(C.GUARDRAIL_BLOCKED)} ELSE pk END AS report_draft
FROM cases JOIN pk USING (msg_id) JOIN nt USING (msg_id)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, msg_id DESC) <= {C.HISTORY_SIZE}"""

    out["campaigns"] = f"""{base}
SELECT d.domain, count(*) AS n_links, count(DISTINCT d.msg_id) AS n_messages,
  count(DISTINCT r.user_id) AS n_users, max(d.risk_score) AS max_risk,
  strftime(min(r.ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(max(r.ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
  first(array_to_string(d.detected_brands, ',')) AS brands
FROM m_dr d JOIN rep r USING (msg_id)
GROUP BY d.domain"""

    out["campaigns_by_day"] = out["campaigns"]
    out["campaign_totals"] = f"""{base},
lk AS (SELECT d.verdict AS domain_verdict, strftime(r.ts, '%Y-%m-%d') AS day, r.user_id, r.ts
       FROM m_dr d JOIN rep r USING (msg_id))
SELECT CASE WHEN GROUPING(domain_verdict) = 0 THEN 'verdict' WHEN GROUPING(day) = 0 THEN 'day' ELSE 'all' END AS level,
  domain_verdict, day, count(*) AS n_links, count(DISTINCT user_id) AS n_users,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM lk GROUP BY GROUPING SETS ((domain_verdict), (day), ()) """
    out["brand_campaigns"] = f"""{base}
SELECT brand, count(DISTINCT msg_id) AS n_messages, count(DISTINCT user_id) AS n_users,
  max(risk_score) AS max_risk, round(avg(risk_score), 2) AS avg_risk
FROM (SELECT msg_id, user_id, risk_score, unnest(h_brand) AS brand FROM rep)
GROUP BY brand"""


def _lite_host() -> str:
    return ("regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(u, "
            "'(?i)^https?://([^/?#\\\\]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www[.]', '')")


def _lite_sql() -> tuple[str, str]:
    fixture = _case_first_sql([(f"contains(upper(coalesce(image, '')), {q(k)})", q(t))
                               for k, t in C.LITE_FIXTURE_TEXTS], "''")
    redacted = (f"regexp_replace(regexp_replace(regexp_replace(lite_text, {q(C.LITE_EMAIL_PATTERN)}, "
                f"{q(C.EMAIL_MASK)}, 'g'), {q(js_re(C.LITE_PHONE_PATTERN))}, {q(C.PHONE_MASK)}, 'g'), "
                f"{q(C.LITE_ID_PATTERN)}, {q(C.LITE_ID_MASK)}, 'g')")
    host = _lite_host()
    steps = _case_first_sql([(f"situation = {q(k)}", qlist(v)) for k, v in C.LITE_SAFE_STEPS.items()],
                            qlist(C.SAFE_STEPS["before_click"]))
    risky = " OR ".join(f"contains(lite_domain, {q(e)})" for e in C.LITE_RISKY_ENDINGS)
    lite = f"""lt0 AS (
  SELECT msg_id, image, situation,
    {trim_sql(f"coalesce(nullif(text, ''), nullif({fixture}, ''), {q(C.LITE_DEFAULT_TEXT)})")} AS lite_text
  FROM acc
),
lt1 AS (
  SELECT *, lower(lite_text) AS low, {redacted} AS lite_redacted,
    regexp_extract_all(lite_text, {q(js_re(C.LITE_URL_PATTERN))}, 0)[1] AS u
  FROM lt0
),
lt2 AS (
  SELECT *, coalesce({host}, '') AS lite_domain,
    contains(low, 'dhl') AS f_dhl, contains(low, 'paypal') AS f_paypal, contains(low, 'fedex') AS f_fedex,
    (contains(low, 'prize') OR contains(low, 'rewards') OR contains(low, 'lottery')) AS f_prize,
    (contains(low, 'qr') OR contains(low, 'microsoft')) AS f_qr,
    regexp_matches(low, {q(C.LITE_PAYMENT_PATTERN)}) AS f_pay,
    regexp_matches(low, {q(C.LITE_DATA_PATTERN)}) AS f_data,
    regexp_matches(low, {q(C.LITE_URGENCY_PATTERN)}) AS f_urg
  FROM lt1
),
lt3 AS (
  SELECT *, CASE WHEN f_dhl THEN 'DHL' WHEN f_paypal THEN 'PAYPAL' WHEN f_fedex THEN 'FEDEX'
                 WHEN f_qr THEN 'MICROSOFT' WHEN f_prize THEN 'GOOGLE' ELSE 'UNKNOWN' END AS lite_brand
  FROM lt2
),
lt4 AS (
  SELECT *, 52 + CASE WHEN lite_domain <> '' THEN 18 ELSE 0 END + CASE WHEN lite_brand <> 'UNKNOWN' THEN 16 ELSE 0 END
            + CASE WHEN f_pay THEN 12 ELSE 0 END + CASE WHEN f_data THEN 12 ELSE 0 END
            + CASE WHEN f_urg THEN 8 ELSE 0 END AS s0
  FROM lt3
),
lt5 AS (
  SELECT *, CAST(least(96,
    CASE WHEN f_qr THEN greatest(72, s3) ELSE s3 END) AS INTEGER) AS lite_score
  FROM (SELECT *, CASE WHEN f_prize THEN greatest(82, s2) ELSE s2 END AS s3
        FROM (SELECT *, CASE WHEN f_fedex THEN greatest(86, s1) ELSE s1 END AS s2
              FROM (SELECT *, CASE WHEN f_paypal THEN greatest(74, s05) ELSE s05 END AS s1
                    FROM (SELECT *, CASE WHEN f_dhl THEN 95 ELSE s0 END AS s05 FROM lt4))))
),
lite AS (
  SELECT *,
    CASE WHEN lite_score >= 70 THEN 'High' WHEN lite_score >= 35 THEN 'Medium' ELSE 'Low' END AS lite_verdict,
    CAST(CASE WHEN lite_domain <> '' THEN least(100, lite_score + CASE WHEN {risky} THEN 5 ELSE 0 END) ELSE 0 END AS INTEGER) AS lite_domain_risk,
    CASE WHEN coalesce(image, '') <> '' THEN 92 ELSE 90 END AS lite_confidence,
    CASE WHEN lite_score >= 70 THEN 'urgent' ELSE 'review' END AS lite_priority,
    [CASE WHEN lite_domain <> '' THEN 'Unsafe destination link detected.' ELSE 'No clickable URL extracted from visible text.' END,
     CASE WHEN lite_brand <> 'UNKNOWN' THEN 'Appears to impersonate a trusted company/institution.' ELSE 'Sender identity cannot be verified from the message.' END,
     CASE WHEN f_pay THEN 'Asks for immediate payment, bank details, or delivery fees.'
          WHEN f_data THEN 'Requests account or identity verification.'
          ELSE 'Uses persuasion language that needs independent verification.' END] AS lite_bd,
    CAST((CASE WHEN lite_brand <> 'UNKNOWN' THEN 1 ELSE 0 END) + (CASE WHEN f_pay THEN 1 ELSE 0 END)
         + (CASE WHEN f_data THEN 1 ELSE 0 END) + (CASE WHEN f_urg THEN 1 ELSE 0 END) AS INTEGER) AS lite_n_indicators,
    list_filter([CASE WHEN lite_domain <> '' THEN 'Highest domain risk' END,
                 CASE WHEN lite_brand <> 'UNKNOWN' THEN 'Brand impersonation' END,
                 CASE WHEN f_pay THEN 'Financial pressure' END,
                 CASE WHEN f_data THEN 'Data collection prompt' END], lambda x: x IS NOT NULL) AS lite_tr,
    {steps} AS lite_steps
  FROM lt5
)"""
    packet = " || chr(10) || ".join([
        q(C.PACKET_HEADER),
        "'Risk: ' || upper(lite_verdict) || ' (' || CAST(lite_score AS VARCHAR) || '/100)'",
        "'Target brand: ' || lite_brand", "'Signals: ' || array_to_string(lite_bd, ', ')",
        q(C.PACKET_PRIVACY), "''", "'First safe move:'", "lite_steps[1]", "''",
        "'Anonymized suspicious content:'", "lite_redacted", "''",
        "'Analyst route: Browser Demo Fallback'"])
    return lite, packet


def _lite(out: dict, base: str) -> None:
    lite, packet = _lite_sql()
    out["lite_triage"] = f"""{base},
{lite}
SELECT msg_id, lite_score, lite_verdict, lite_brand, lite_domain, lite_domain_risk, lite_confidence,
  lite_priority, lite_n_indicators, array_to_string(lite_bd, ' | ') AS lite_breakdown,
  array_to_string(lite_tr, ' | ') AS lite_trace, lite_redacted, {packet} AS lite_packet
FROM lite"""
    risk_sev = "CASE WHEN lite_domain_risk >= 70 THEN 'high' ELSE 'medium' END"
    out["lite_reports"] = f"""{base},
{lite},
lr AS (
  SELECT *, list_filter([
      CASE WHEN lite_domain <> '' THEN {{'label': 'Highest domain risk', 'impact': lite_domain_risk, 'severity': {risk_sev},
        'evidence': lite_domain || ': unverified destination in a suspicious message.'}} END,
      CASE WHEN lite_brand <> 'UNKNOWN' THEN {{'label': 'Brand impersonation', 'impact': 16, 'severity': 'medium',
        'evidence': 'Message claims to be from ' || lite_brand || '.'}} END,
      CASE WHEN f_pay THEN {{'label': 'Financial pressure', 'impact': 12, 'severity': 'medium',
        'evidence': 'Payment, fee, prize, or transfer language detected.'}} END,
      CASE WHEN f_data THEN {{'label': 'Data collection prompt', 'impact': 12, 'severity': 'medium',
        'evidence': 'Message asks for verification, login, identity, or credential action.'}} END
    ], lambda x: x IS NOT NULL)[1:4] AS tr
  FROM lite
)
SELECT msg_id,
  array_to_string(list_transform(tr, lambda t: t.label || ' +' || CAST(t.impact AS VARCHAR) || ' ' || t.severity), ' | ') AS score_trace,
  array_to_string(list_transform(tr, lambda t: t.evidence), ' | ') AS trace_evidence,
  'Classified this as ' || lite_verdict || ' risk (' || CAST(lite_score AS VARCHAR) || '/100) using browser demo evidence.' AS note_summary,
  lite_priority AS note_priority,
  array_to_string(list_transform(tr[1:3], lambda t: t.label), ' | ') AS note_evidence,
  array_to_string(lite_steps, ' | ') AS note_actions,
  array_to_string([
    CASE WHEN coalesce(image, '') <> '' THEN 'Screenshot Fixture OCR: Loaded deterministic screenshot fixture text in browser demo mode.'
         ELSE 'PII Redaction: Redacted sensitive values locally for browser demo mode.' END,
    'Link Extraction: ' || CASE WHEN lite_domain <> '' THEN 'Found ' || lite_domain || '.' ELSE 'No URL extracted.' END,
    'Domain Inspection: ' || CASE WHEN lite_domain <> '' THEN 'Applied browser demo domain-pattern scoring.'
                                  ELSE 'Skipped domain scoring because no URL was present.' END,
    'Threat Intelligence Check: Matched social-engineering demo signals.',
    'Risk Synthesis: Assigned ' || lite_verdict || ' risk (' || CAST(lite_score AS VARCHAR) || '/100).',
    'Safety Planner: Generated contextual user-safe next steps.',
    {q(C.STEP_NOTE + ': Backend unavailable; browser demo fallback explanation attached.')},
    'Incident Report Generator: Built a compact client-side demo case packet.'], ' | ') AS steps
FROM lr"""
    out["lite_domain_records"] = f"""{base},
{lite}
SELECT msg_id, CAST(CASE WHEN lite_domain <> '' THEN 1 ELSE 0 END AS INTEGER) AS n_records,
  nullif(lite_domain, '') AS domain, CASE WHEN lite_domain <> '' THEN lite_domain_risk ELSE 0 END AS risk_score,
  CASE WHEN lite_domain <> '' THEN CASE WHEN lite_domain_risk >= 70 THEN 'High'
       WHEN lite_domain_risk >= 35 THEN 'Medium' ELSE 'Low' END END AS verdict,
  CASE WHEN lite_domain <> '' THEN array_to_string(lite_bd, ' | ') END AS indicators,
  CASE WHEN lite_domain <> '' THEN CASE WHEN lite_brand = 'UNKNOWN' THEN '' ELSE lower(lite_brand) END END AS brands,
  CASE WHEN coalesce(image, '') <> '' THEN lite_text END AS extracted_text
FROM lite"""
    out["browser_payloads"] = f"""{base},
{lite},
ll AS (
  SELECT *, regexp_extract_all(lite_text, {q(js_re(C.LITE_URL_PATTERN))}, 0) AS urls,
    list_filter([
      CASE WHEN lite_domain <> '' THEN {{'label': 'Highest domain risk', 'impact': lite_domain_risk,
        'source': 'client_demo_domain_pattern', 'severity': {risk_sev},
        'evidence': lite_domain || ': unverified destination in a suspicious message.',
        'calculation': 'demo domain pattern score'}} END,
      CASE WHEN lite_brand <> 'UNKNOWN' THEN {{'label': 'Brand impersonation', 'impact': 16,
        'source': 'client_demo_brand_signal', 'severity': 'medium',
        'evidence': 'Message claims to be from ' || lite_brand || '.', 'calculation': 'matched trusted brand signal'}} END,
      CASE WHEN f_pay THEN {{'label': 'Financial pressure', 'impact': 12, 'source': 'client_demo_social_signal',
        'severity': 'medium', 'evidence': 'Payment, fee, prize, or transfer language detected.',
        'calculation': 'social engineering hook'}} END,
      CASE WHEN f_data THEN {{'label': 'Data collection prompt', 'impact': 12, 'source': 'client_demo_privacy_signal',
        'severity': 'medium', 'evidence': 'Message asks for verification, login, identity, or credential action.',
        'calculation': 'credential/data hook'}} END], lambda x: x IS NOT NULL)[1:4] AS tr,
    list_filter([
      CASE WHEN lite_brand <> 'UNKNOWN' THEN {{'category': {q(C.BRAND)}, 'detail': 'Claims to represent ' || lite_brand
        || ' while routing to an unverified destination.'}} END,
      CASE WHEN f_pay THEN {{'category': {q(C.FINANCIAL)}, 'detail': 'Mentions a payment, fee, prize, or transfer pressure.'}} END,
      CASE WHEN f_data THEN {{'category': {q(C.DATA)}, 'detail': 'Pushes the user toward account, identity, or credential confirmation.'}} END,
      CASE WHEN f_urg THEN {{'category': 'Urgency Pressure', 'detail': 'Uses time pressure or account consequences to rush action.'}} END
    ], lambda x: x IS NOT NULL) AS ind
  FROM lite
)
SELECT msg_id, CAST(to_json({{
  'context': {_sit_label('situation')}, 'verdict': lite_verdict, 'risk_score': lite_score,
  'confidence': lite_confidence, 'redacted_text': lite_redacted,
  'links': list_transform(urls, lambda u: {{'domain': {_lite_host()}}}),
  'domain_reports': CASE WHEN lite_domain <> '' THEN [{{'domain': lite_domain, 'risk_score': lite_domain_risk,
      'verdict': CASE WHEN lite_domain_risk >= 70 THEN 'High' WHEN lite_domain_risk >= 35 THEN 'Medium' ELSE 'Low' END,
      'indicators': lite_bd,
      'detected_brands': CASE WHEN lite_brand = 'UNKNOWN' THEN []::VARCHAR[] ELSE [lower(lite_brand)] END}}]
    ELSE []::STRUCT(domain VARCHAR, risk_score INTEGER, verdict VARCHAR, indicators VARCHAR[], detected_brands VARCHAR[])[] END,
  'social_engineering_indicators': ind, 'score_trace': tr, 'local_next_actions': lite_steps}}) AS VARCHAR) AS payload
FROM ll"""
    out["lite_agreement_totals"] = f"""{base},
{lite}
SELECT r.verdict AS full_verdict, l.lite_verdict,
  CAST(GROUPING(r.verdict) * 2 + GROUPING(l.lite_verdict) AS INTEGER) AS level, count(*) AS n_messages,
  CAST(sum(CASE WHEN r.verdict = l.lite_verdict THEN 1 ELSE 0 END) AS BIGINT) AS n_agree
FROM rep r JOIN lite l USING (msg_id) GROUP BY CUBE (r.verdict, l.lite_verdict)"""
    out["lite_agreement"] = f"""{base},
{lite}
SELECT r.verdict AS full_verdict, l.lite_verdict, count(*) AS n_messages
FROM rep r JOIN lite l USING (msg_id) GROUP BY r.verdict, l.lite_verdict"""


def _case_first_sql(pairs, default="NULL") -> str:
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
    return f"CASE {whens} ELSE {default} END"


def _streams(out: dict, base: str) -> None:
    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    out["stream_reports"] = f"""{base},
pk AS (SELECT *, {packet_sql()} AS pk FROM rep)
SELECT msg_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, situation, verdict, risk_score, confidence,
  CAST(n_reports AS INTEGER) AS domain_count, CAST(n AS INTEGER) AS indicator_count,
  CASE WHEN {guard} THEN {q(C.GUARDRAIL_BLOCKED)} ELSE pk END AS report_draft
FROM pk"""
    # a bounded run returns every window and session, closed or still open
    out["stream_verdict_windows"] = f"""{base}
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
  verdict, count(*) AS n_messages, max(risk_score) AS max_score
FROM rep
GROUP BY 1, 2, 3"""
    out["stream_sliding_windows"] = f"""{base},
wk AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS w_start
       FROM rep, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT strftime(w_start, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(w_start + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
  verdict, count(*) AS n_messages, max(risk_score) AS max_score
FROM wk
GROUP BY 1, 2, 3"""
    out["stream_user_sessions"] = f"""{base},
sx AS (SELECT user_id, ts, risk_score,
         CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
              THEN 1 ELSE 0 END AS starts
       FROM rep),
sy AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM sx),
sz AS (SELECT user_id, sid, min(ts) AS s_start, max(ts) + INTERVAL 30 MINUTE AS s_end,
         count(*) AS n_messages, max(risk_score) AS max_score FROM sy GROUP BY user_id, sid)
SELECT user_id, strftime(s_start, '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(s_end, '%Y-%m-%d %H:%M:%S') AS session_end, n_messages, max_score
FROM sz"""
    out["stream_history"] = f"""{base}
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, msg_id DESC) AS INTEGER) AS rank,
  msg_id, verdict, risk_score
FROM rep
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, msg_id DESC) <= {C.HISTORY_SIZE}"""
    out["stream_dedup"] = f"""{base}
SELECT msg_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM msgs"""


def _notes(out: dict, base: str) -> None:
    from ..sources.responses import N_SCENARIOS, attempt_columns, steps_values_sql
    cols = ", ".join(f"{expr} AS {name}" for name, expr in attempt_columns())
    c = "coalesce(content, '{}')"
    t = strip_sql(c)
    first = f"instr({c}, '{{')"
    last = f"(length({c}) - instr(reverse({c}), '}}') + 1)"
    cand = (f"CASE WHEN json_valid({t}) THEN {t} "
            f"WHEN {first} > 0 AND instr({c}, '}}') > 0 AND {last} > {first} "
            f"THEN substring({c}, {first}, {last} - {first} + 1) END")
    sev = "lower(verdict)"

    def s(x):
        return strip_sql(x)
    sig_obj = s("coalesce(json_extract_string(e, '$.signal'), '')")
    sig_val = s("json_extract_string(e, '$')")
    why_obj = s("coalesce(json_extract_string(e, '$.why_it_matters'), '')")
    sev_obj = s(f"coalesce(json_extract_string(e, '$.severity'), {sev})")
    item_signal = f"CASE WHEN json_type(e) = 'OBJECT' THEN {sig_obj} ELSE {sig_val} END"
    item_why = f"CASE WHEN json_type(e) = 'OBJECT' THEN {why_obj} ELSE {q(C.NOTE_WHY_DEFAULT)} END"
    item_sev = f"CASE WHEN json_type(e) = 'OBJECT' THEN lower({sev_obj}) ELSE {sev} END"

    def str_list(key):
        arr = f"json_extract(cand, '$.{key}')"
        elem = s("json_extract_string(e, '$')")
        items = (f"list_filter(list_transform(json_extract({arr}, '$[*]'), lambda e: {elem}), "
                 f"lambda x: x <> '')[1:3]")
        single = s(f"json_extract_string(cand, '$.{key}')")
        return (f"CASE WHEN json_type({arr}) = 'ARRAY' THEN {items} "
                f"WHEN json_type({arr}) = 'VARCHAR' AND {single} <> '' THEN [{single}] "
                f"ELSE []::VARCHAR[] END")
    out["analyst_notes_live"] = f"""{base},
att AS (SELECT {cols} FROM acc JOIN {steps_values_sql()} ON s.scenario = acc.msg_id % {N_SCENARIOS}),
at1 AS (
  SELECT *, {cand} AS cand FROM att
),
at2 AS (
  SELECT *, CASE WHEN http_code = 200 AND json_valid(cand) THEN json_type(cand) = 'OBJECT' ELSE false END AS ok,
    CASE WHEN http_code IS NULL THEN model || ' -> ' || substring(coalesce(error, 'no answer'), 1, 240)
         WHEN http_code <> 200 THEN model || ' -> ' || CAST(http_code AS VARCHAR) || ': ' || substring(coalesce(error, ''), 1, 240)
         ELSE model || ' -> invalid JSON object' END AS failure
  FROM at1
),
at3 AS (
  SELECT a.*, (a.attempt = 0 OR EXISTS (SELECT 1 FROM at2 b WHERE b.msg_id = a.msg_id AND b.model_rank = a.model_rank
                                        AND b.attempt = 0 AND NOT b.ok
                                        AND (coalesce(b.http_code = 429, false) OR contains(coalesce(b.error, ''), '429')))) AS reachable,
    EXISTS (SELECT 1 FROM at2 b WHERE b.msg_id = a.msg_id AND b.model_rank = a.model_rank AND b.attempt = 1) AS has_retry,
    NOT ok AND (coalesce(http_code = 429, false) OR contains(coalesce(error, ''), '429')) AS busy
  FROM at2 a
),
win AS (
  SELECT msg_id, model_rank AS w_rank, coalesce(response_model, model) AS w_model, request_id AS w_req, usage AS w_usage, cand
  FROM at3 WHERE reachable AND ok
  QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY model_rank, attempt) = 1
),
fails AS (
  SELECT a.msg_id, {q(C.REASON_ROUTING)} || coalesce(string_agg(a.failure, ' | ' ORDER BY a.model_rank, a.attempt)
      FILTER (WHERE a.k <= 3), '') AS reason
  FROM (SELECT a.*, row_number() OVER (PARTITION BY a.msg_id ORDER BY a.model_rank, a.attempt) AS k
        FROM at3 a LEFT JOIN win w USING (msg_id)
        WHERE a.reachable AND NOT a.ok AND NOT (a.attempt = 0 AND a.busy AND a.has_retry)
          AND (w.w_rank IS NULL OR a.model_rank < w.w_rank)) a
  GROUP BY a.msg_id
),
has_att AS (SELECT DISTINCT msg_id FROM att),
nt AS (
  SELECT r.*, w.w_model, w.w_req, w.w_usage, w.cand, f.reason,
    (w.cand IS NOT NULL AND NOT coalesce(r.demo_offline, false)) AS live
  FROM rep r LEFT JOIN win w USING (msg_id) LEFT JOIN fails f USING (msg_id)
),
ev AS (
  SELECT msg_id, list_filter(list_transform(
      (CASE WHEN json_type(json_extract(cand, '$.evidence')) = 'ARRAY'
            THEN json_extract(json_extract(cand, '$.evidence'), '$[*]') ELSE [] END)[1:5],
      lambda e: {{'signal': {item_signal}, 'why': {item_why}, 'sev': {item_sev}}}), lambda x: x.signal <> '') AS items
  FROM nt WHERE live
)
SELECT msg_id,
  CASE WHEN live THEN 'model_route' ELSE {q(C.NOTE_PROVIDER)} END AS provider,
  CASE WHEN live THEN w_model ELSE {q(C.NOTE_MODEL)} END AS model,
  CASE WHEN live THEN 'live' ELSE 'fallback' END AS status,
  CASE WHEN live THEN NULL WHEN coalesce(demo_offline, false) THEN {q(C.REASON_OFFLINE)}
       WHEN reason IS NOT NULL THEN reason ELSE {q(C.REASON_NO_RESPONSE)} END AS fallback_reason,
  CASE WHEN live THEN w_req END AS request_id, CASE WHEN live THEN w_usage END AS usage,
  CASE WHEN live THEN {s("coalesce(json_extract_string(cand, '$.executive_summary'), '')")}
       ELSE 'Classified this as ' || verdict || ' risk (' || CAST(risk_score AS VARCHAR) || '/100) using local rules.' END AS executive_summary,
  CASE WHEN live THEN {s(f"coalesce(json_extract_string(cand, '$.recommended_priority'), {_priority('verdict', 'situation')})")}
       ELSE {_priority('verdict', 'situation')} END AS recommended_priority,
  CAST(CASE WHEN live THEN len(ev.items) ELSE len(breakdown[1:5]) END AS INTEGER) AS n_evidence,
  CASE WHEN live THEN array_to_string(list_transform(ev.items, lambda x: x.signal), ' | ')
       ELSE array_to_string(breakdown[1:5], ' | ') END AS evidence,
  CASE WHEN live THEN array_to_string(list_transform(ev.items, lambda x: CASE WHEN x.why = '' THEN {q(C.NOTE_WHY_DEFAULT)} ELSE x.why END), ' | ')
       ELSE array_to_string(list_transform(breakdown[1:5], lambda b: {q(C.NOTE_WHY_RULE)}), ' | ') END AS evidence_why,
  CASE WHEN live THEN array_to_string(list_transform(ev.items, lambda x: CASE WHEN x.sev IN ('low', 'medium', 'high') THEN x.sev ELSE lower(verdict) END), ',')
       ELSE array_to_string(list_transform(breakdown[1:5], lambda b: lower(verdict)), ',') END AS evidence_severity,
  CASE WHEN live THEN array_to_string({str_list('questions')}, ' | ')
       ELSE array_to_string(questions[1:3], ' | ') END AS questions,
  CASE WHEN live THEN array_to_string({str_list('next_actions')}, ' | ')
       ELSE array_to_string(list_transform(safe_steps[1:3], lambda x: replace(x, '**', '')), ' | ') END AS next_actions,
  CASE WHEN live THEN 'Model enrichment completed via ' || w_model || '.'
       ELSE 'Model enrichment unavailable. Deterministic explanation attached.' END AS analyst_step
FROM nt LEFT JOIN ev USING (msg_id)"""


def _values(rows, cols) -> str:
    def lit(v):
        return "NULL" if v is None else (q(v) if isinstance(v, str) else str(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def _catalogues(out: dict, base: str) -> None:
    import json
    from ..sources.fixtures import MANIFEST
    samples = _values([(n, src, sit, txt) for n, src, sit, txt in C.SAMPLES],
                      ["name", "sample_source", "sample_situation", "text"])
    out["sample_matches"] = f"""WITH msgs AS ({view_sql('events')})
SELECT m.msg_id, t.name AS sample, t.sample_source, m.situation AS requested_situation,
  CASE WHEN m.situation IS NOT NULL AND m.situation <> 'before_click' THEN m.situation
       ELSE coalesce(t.sample_situation, m.situation) END AS situation
FROM msgs m JOIN {samples} ON m.text = t.text"""
    with open(MANIFEST) as fh:
        fixtures = json.load(fh)["fixtures"]
    man = _values([(f["id"], f["marker"], f["expected_verdict"]) for f in fixtures],
                  ["fixture_id", "marker", "expected_verdict"])
    out["screenshot_fixtures"] = f"""{base}
SELECT r.msg_id, t.fixture_id, t.expected_verdict, r.verdict, (t.expected_verdict = r.verdict) AS agrees
FROM (SELECT * FROM rep WHERE has_image) r LEFT JOIN {man} ON contains(upper(r.image), t.marker)"""
    unions = "\nUNION ALL\n".join(
        f"SELECT msg_id, {q(cat)} AS category, CAST(generate_subscripts({h}, 1) AS INTEGER) AS rank, "
        f"unnest({h}) AS keyword FROM s_sg" for h, cat in
        [("h_urg", C.URGENCY), ("h_fin", C.FINANCIAL), ("h_data", C.DATA), ("h_rel", C.RELATIONSHIP)])
    out["lexicon_hits"] = out["signal_hits_long"]
    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    out["packet_files"] = f"""{base},
pk AS (SELECT *, {packet_sql()} AS pk FROM rep)
SELECT msg_id, verdict, CASE WHEN {guard} THEN {q(C.GUARDRAIL_BLOCKED)} ELSE pk END AS packet FROM pk"""

def _labels(out: dict, base: str) -> None:
    nl = " || chr(10) || "
    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    draft = f"CASE WHEN {guard} THEN {q(C.GUARDRAIL_BLOCKED)} ELSE pk END"
    html = draft
    for ch, ent in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]:
        html = f"replace({html}, {q(ch)}, {q(ent)})"
    prio = _priority("verdict", "situation")
    b = "lower(breakdown[1])"

    def any_of(words):
        return " OR ".join(f"contains({b}, {q(w)})" for w in words)
    topic = (f"CASE WHEN {any_of(['link', 'destination'])} THEN 'link' "
             f"WHEN {any_of(['urgency', 'threat'])} THEN 'urgency' "
             f"WHEN {any_of(['impersonate', 'trusted'])} THEN 'brand' "
             f"WHEN {any_of(['payment', 'bank', 'fee'])} THEN 'payment' "
             f"WHEN {any_of(['credential', 'code', 'data'])} THEN 'credential' ELSE 'warning' END")
    actions = ("array_to_string(list_transform(safe_steps[1:3], lambda s, i: CAST(i AS VARCHAR) || '. ' || s), chr(10))")
    share = nl.join([
        "'Risk summary'",
        "'Verdict: ' || verdict || ' (' || CAST(risk_score AS VARCHAR) || '/100), confidence ' || CAST(confidence AS VARCHAR) || '%'",
        f"'Context: ' || {_sit_label('situation')}",
        "'AI analyst: Local Fallback'",
        "'Domains: ' || CASE WHEN n_reports > 0 THEN array_to_string(domain_scores, ', ') ELSE 'none' END",
        "'Signals: ' || array_to_string(breakdown, '; ')",
        "'Score trace: ' || top3",
        "''", "'Recommended next actions:'", actions])
    short = nl.join([
        "'Verdict: ' || verdict || ' (' || CAST(risk_score AS VARCHAR) || '/100)'",
        "'Confidence: ' || CAST(confidence AS VARCHAR) || '%'",
        "'Top signal: ' || coalesce(nullif(first_label, ''), nullif(breakdown[1], ''), 'review needed')",
        "'Action: ' || coalesce(nullif(safe_steps[1], ''), 'Use official channels before interacting.')"])
    out["breakdown_topics"] = f"""{base},
bl AS (SELECT msg_id, unnest(breakdown) AS line, CAST(generate_subscripts(breakdown, 1) AS INTEGER) AS pos FROM rep)
SELECT msg_id, pos, line, {topic.replace(b, 'lower(line)')} AS topic FROM bl"""
    start, *anywhere = C.DASHBOARD_SIGNS
    sign = f"(?s)^(?:{start}[{JS_SPACE}]*|(.*?)(?:{'|'.join(anywhere)})[{JS_SPACE}]*)"
    out["dashboard_steps"] = f"""{base},
st AS (SELECT msg_id, unnest(safe_steps) AS step, CAST(generate_subscripts(safe_steps, 1) AS INTEGER) AS step_no FROM rep)
SELECT msg_id, step_no, replace(regexp_replace(step, {q(sign)}, '\\1'), '**', '') AS step FROM st"""
    out["popup_previews"] = f"""{base},
{trace_rows_sql().strip()},
pl AS (SELECT msg_id, string_agg('+' || CAST(impact AS VARCHAR) || ' ' || label || ' [' || CASE WHEN impact >= 70 THEN 'danger'
         WHEN impact >= 35 THEN 'warning' ELSE 'safe' END || ']', ' | ' ORDER BY pos) AS pills
       FROM trp WHERE pos <= 3 GROUP BY msg_id)
SELECT msg_id, verdict || ' / ' || CAST(risk_score AS VARCHAR) AS headline,
  'Classified this as ' || verdict || ' risk (' || CAST(risk_score AS VARCHAR) || '/100) using local rules.' AS summary,
  coalesce(pills, '') AS pills, coalesce(nullif(safe_steps[1], ''), 'Use official channels before interacting.') AS next_step
FROM rep LEFT JOIN pl USING (msg_id)"""
    out["report_labels"] = f"""{base},
{trace_rows_sql().strip()},
pk AS (SELECT *, {packet_sql()} AS pk FROM rep),
tt AS (SELECT msg_id, string_agg(label || ' +' || CAST(impact AS VARCHAR), '; ' ORDER BY pos) FILTER (WHERE pos <= 3) AS top3,
              max(CASE WHEN pos = 1 THEN label END) AS first_label FROM trp GROUP BY msg_id)
SELECT msg_id, {_sit_label('situation')} AS situation_label, 'Local Fallback' AS route_label,
  CASE WHEN risk_score >= 70 THEN 'danger' WHEN risk_score >= 35 THEN 'warning' ELSE 'safe' END AS risk_band,
  CASE WHEN {prio} IN ('lockdown', 'urgent', 'high') THEN 'danger' WHEN {prio} IN ('caution', 'medium') THEN 'warning' ELSE 'safe' END AS priority_band,
  verdict || ' (' || CAST(risk_score AS VARCHAR) || '/100)' AS status_line,
  {short} AS short_summary, {share} AS share_summary, {topic} AS first_breakdown_topic,
  {html} AS packet_html
FROM pk JOIN tt USING (msg_id)"""


def _conversations(out: dict) -> None:
    sel = f"""SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn, {trim_sql('text')} AS text,
  'before_click' AS situation, CAST(NULL AS VARCHAR) AS image, false AS demo_offline
FROM conversations WHERE length({trim_sql('text')}) > 0"""
    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    out["conversation_reports"] = f"""{base_ctes(sel)},
pk AS (SELECT *, {packet_sql()} AS pk FROM rep)
SELECT conv_id, turn, situation, verdict, risk_score, confidence,
  CAST(n_reports AS INTEGER) AS n_links, CAST(n AS INTEGER) AS n_categories,
  array_to_string(list_transform(indicators, lambda i: i.category), '|') AS categories,
  verdict || ' (' || CAST(risk_score AS VARCHAR) || '/100)' AS status_line,
  {guard} AS guard_failed
FROM pk"""


def _texts(out: dict) -> None:
    """Full reports over whole documents and pages."""
    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    for name, key, text, table in (("document_reports", "doc_id", "text", "documents"),
                                   ("page_reports", "page_id", "html", "pages")):
        sel = (f"SELECT {key} AS msg_id, {text} AS text, 'before_click' AS situation, "
               f"CAST(NULL AS VARCHAR) AS image, false AS demo_offline FROM {table}")
        # every text counts, blank ones too
        base = base_ctes(sel).replace(f"acc AS (SELECT * FROM msgs WHERE {valid_sql()})", "acc AS (SELECT * FROM msgs)")
        out[name] = f"""{base},
{_trace_text_sql().strip()},
its AS (SELECT msg_id, string_agg(detail, ' | ' ORDER BY k) AS trace FROM it GROUP BY msg_id)
SELECT msg_id AS {key}, verdict, risk_score, confidence, CAST(m AS INTEGER) AS max_domain_score,
  CASE WHEN m > 0 THEN top_domain END AS top_domain, CAST(n_reports AS INTEGER) AS n_links,
  array_to_string(list_transform(indicators, lambda i: i.category), '|') AS categories,
  array_to_string(breakdown, ' | ') AS breakdown, trace, {guard} AS guard_failed,
  md5(CASE WHEN {guard} THEN {q(C.GUARDRAIL_BLOCKED)} ELSE pk END) AS draft_md5
FROM pk JOIN its USING (msg_id)"""


def _intake(out: dict, base: str) -> None:
    """Requests read back from files, messages without an answer, exports by day, transcriptions."""
    given = ("CASE WHEN msg_id % 4 = 0 THEN 'Transcript of ' || CAST(msg_id AS VARCHAR) || ': pay at https://ocr-' "
             "|| CAST(user_id AS VARCHAR) || '.top/now' END")
    with_ocr = base.replace(screenshot_sql(), screenshot_sql(f"({given})"))
    out["ocr_texts"] = f"""{with_ocr}
SELECT msg_id, raw_text, risk_score, CAST(n_reports AS INTEGER) AS n_links FROM rep WHERE has_image"""
    msgs = f"msgs AS ({view_sql('events')})"
    samples = _values([(n, txt) for n, _, _, txt in C.SAMPLES], ["name", "sample"])
    out["request_intake"] = f"""WITH {msgs},
req AS (SELECT * REPLACE (coalesce(text, '') AS text), msg_id % 17 = 3 AS cut FROM msgs)
SELECT 'json' AS kind, msg_id, CASE WHEN NOT cut THEN situation END AS situation,
  CASE WHEN cut THEN 'The request is not valid JSON.' ELSE {reject_sql()} END AS reject_reason,
  CAST(CASE WHEN cut THEN 0 ELSE length(text) END AS INTEGER) AS n_chars, true AS has_source
FROM req
UNION ALL
SELECT 'text', -1, 'before_click', NULL, CAST(length(text) + 1 AS INTEGER), true
FROM (SELECT DISTINCT t.name, m.text FROM msgs m JOIN {samples} ON m.text = t.sample)"""
    notes = out["analyst_notes_live"]
    out["unanswered_messages"] = f"""WITH won AS ({notes[:notes.rindex('SELECT msg_id,')]} SELECT msg_id FROM win),
{msgs}
SELECT msg_id, situation, demo_offline FROM msgs
WHERE {valid_sql()} AND msg_id NOT IN (SELECT msg_id FROM won)"""
    exports = out["report_exports"]
    out["export_files"] = f"""WITH x AS ({exports})
SELECT json_extract_string(export_json, '$.exported_at')[1:10] AS day, export_json FROM x"""


def _overlay(out: dict, base: str) -> None:
    from ..sources.responses import N_SCENARIOS, attempt_columns, steps_values_sql
    lite, packet = _lite_sql()
    cols = ", ".join(f"{expr} AS {name}" for name, expr in attempt_columns())
    t = trim_sql("b_content")
    t2 = trim_sql(f"regexp_replace(regexp_replace({t}, '(?i)^```(?:json)?', ''), '```$', '')")
    first = f"instr(t2, '{{')"
    last = f"(length(t2) - instr(reverse(t2), '}}') + 1)"
    cand = (f"CASE WHEN json_valid(t2) THEN t2 "
            f"WHEN {first} > 0 AND instr(t2, '}}') > 0 AND {last} > {first} "
            f"THEN substring(t2, {first}, {last} - {first} + 1) END")

    def arr(key):
        return f"json_extract(obj, '$.{key}')"

    def items(key, n):
        text = "json_extract_string(e, '$')"
        if key == "evidence":
            text = f"CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.signal') ELSE {text} END"
        return f"list_transform(json_extract({arr(key)}, '$[*]'), lambda e: {text})[1:{n}]"
    qs = qlist(C.LITE_NOTE_QUESTIONS)
    overlay = f"""{base},
{lite},
lr AS (
  SELECT *, list_filter([
      CASE WHEN lite_domain <> '' THEN 'Highest domain risk' END,
      CASE WHEN lite_brand <> 'UNKNOWN' THEN 'Brand impersonation' END,
      CASE WHEN f_pay THEN 'Financial pressure' END,
      CASE WHEN f_data THEN 'Data collection prompt' END], lambda x: x IS NOT NULL)[1:3] AS note_ev,
    'Classified this as ' || lite_verdict || ' risk (' || CAST(lite_score AS VARCHAR) || '/100) using browser demo evidence.' AS note_summary,
    {packet} AS lite_packet
  FROM lite
),
att AS (SELECT {cols} FROM acc JOIN {steps_values_sql()} ON s.scenario = acc.msg_id % {N_SCENARIOS}),
ba AS (
  SELECT msg_id, model AS b_model, content AS b_content FROM att WHERE http_code = 200
  QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY model_rank, attempt) = 1
),
bp AS (SELECT *, {t2} AS t2 FROM ba),
bo AS (SELECT msg_id, b_model,
         CASE WHEN json_valid({cand}) THEN CASE WHEN json_type({cand}) = 'OBJECT' THEN ({cand}) ELSE '{{}}' END
              ELSE '{{}}' END AS obj
       FROM bp),
ov AS (
  SELECT l.*, b.b_model, b.obj, l.msg_id IN (SELECT msg_id FROM att) AS called,
    coalesce(nullif(json_extract_string(b.obj, '$.executive_summary'), ''), l.note_summary) AS b_summary
  FROM lr l LEFT JOIN bo b USING (msg_id)
)"""
    step = (f"CASE WHEN b_model IS NOT NULL THEN 'Model enrichment completed via browser route (' || b_model || ').' "
            f"WHEN called THEN {q(C.OVERLAY_FAILED)} "
            "ELSE 'Backend unavailable; browser demo fallback explanation attached.' END")
    out["browser_reports"] = f"""{overlay}
SELECT msg_id, CASE WHEN b_model IS NOT NULL THEN 'live' ELSE 'fallback' END AS status, b_model IS NULL AS fallback_used,
  CASE WHEN b_model IS NOT NULL THEN coalesce(nullif(json_extract_string(obj, '$.user_explanation'), ''),
       {q(C.LITE_NOTE_EXPLANATION)}) ELSE {q(C.LITE_NOTE_EXPLANATION)} END AS user_explanation,
  CASE WHEN b_model IS NOT NULL THEN coalesce(nullif(json_extract_string(obj, '$.confidence_note'), ''),
       {q(C.OVERLAY_CONFIDENCE)}) ELSE {q(C.LITE_NOTE_CONFIDENCE)} END AS confidence_note,
  array_to_string(CASE WHEN b_model IS NOT NULL AND json_type({arr('next_actions')}) = 'ARRAY'
       AND json_array_length({arr('next_actions')}) > 0 THEN {items('next_actions', 5)} ELSE lite_steps END, ' | ') AS safe_steps,
  array_to_string([
    CASE WHEN coalesce(image, '') <> '' THEN 'Screenshot Fixture OCR: Loaded deterministic screenshot fixture text in browser demo mode.'
         ELSE 'PII Redaction: Redacted sensitive values locally for browser demo mode.' END,
    'Link Extraction: ' || CASE WHEN lite_domain <> '' THEN 'Found ' || lite_domain || '.' ELSE 'No URL extracted.' END,
    'Domain Inspection: ' || CASE WHEN lite_domain <> '' THEN 'Applied browser demo domain-pattern scoring.'
                                  ELSE 'Skipped domain scoring because no URL was present.' END,
    'Threat Intelligence Check: Matched social-engineering demo signals.',
    'Risk Synthesis: Assigned ' || lite_verdict || ' risk (' || CAST(lite_score AS VARCHAR) || '/100).',
    'Safety Planner: Generated contextual user-safe next steps.',
    {q(C.STEP_NOTE + ': ')} || {step},
    'Incident Report Generator: Built a compact client-side demo case packet.'], ' | ') AS trace
FROM ov"""
    out["browser_overlay"] = f"""{overlay},
fin AS (
  SELECT msg_id,
    CASE WHEN b_model IS NOT NULL THEN 'browser_model_route' ELSE 'browser-demo' END AS overlay_provider,
    CASE WHEN b_model IS NOT NULL THEN b_model ELSE 'client-demo-fallback' END AS overlay_model,
    CASE WHEN b_model IS NOT NULL THEN coalesce(nullif(json_extract_string(obj, '$.recommended_priority'), ''),
                                                nullif(lite_priority, ''), 'review')
         ELSE lite_priority END AS overlay_priority,
    CASE WHEN b_model IS NOT NULL THEN b_summary ELSE note_summary END AS overlay_summary,
    CASE WHEN b_model IS NOT NULL AND json_type({arr('evidence')}) = 'ARRAY' THEN {items('evidence', 4)}
         ELSE note_ev END AS ev,
    CASE WHEN b_model IS NOT NULL AND json_type({arr('next_actions')}) = 'ARRAY'
              AND json_array_length({arr('next_actions')}) > 0 THEN {items('next_actions', 5)}
         ELSE lite_steps END AS acts,
    CASE WHEN b_model IS NOT NULL AND json_type({arr('questions')}) = 'ARRAY' THEN {items('questions', 3)}
         ELSE {qs} END AS qs,
    CASE WHEN b_model IS NOT NULL THEN replace(lite_packet, 'Analyst route: Browser Demo Fallback',
              'Analyst route: Browser Model (' || b_model || ')') || chr(10) || chr(10) || 'Model summary:' || chr(10) || b_summary
         ELSE lite_packet END AS overlay_packet,
    CASE WHEN b_model IS NOT NULL THEN 'Model enrichment completed via browser route (' || b_model || ').'
         WHEN called THEN {q(C.OVERLAY_FAILED)}
         ELSE 'Backend unavailable; browser demo fallback explanation attached.' END AS overlay_step
  FROM ov
)
SELECT msg_id, overlay_provider, overlay_model, overlay_priority, overlay_summary,
  CAST(len(ev) AS INTEGER) AS n_evidence, array_to_string(ev, ' | ') AS evidence,
  array_to_string(acts, ' | ') AS next_actions, array_to_string(qs, ' | ') AS questions,
  overlay_packet, overlay_step
FROM fin"""


def _payloads(out: dict, base: str) -> None:
    routes = [C.MODEL_ROUTES[2]] + [m for m in C.MODEL_ROUTES if m != C.MODEL_ROUTES[2]]
    empty_reports = ("[]::STRUCT(domain VARCHAR, risk_score INTEGER, verdict VARCHAR, "
                     "indicators VARCHAR[], detected_brands VARCHAR[])[]")
    out["prompt_payloads"] = f"""{base},
drl AS (
  SELECT msg_id, list({{'domain': domain, 'risk_score': risk_score, 'verdict': verdict,
                        'indicators': indicators, 'detected_brands': detected_brands}} ORDER BY pos) AS reports
  FROM m_dr GROUP BY msg_id
)
SELECT r.msg_id,
  CAST(to_json({{'redacted_message': substring(r.redacted_text, 1, {C.PROMPT_CHARS}),
                 'user_situation': r.situation,
                 'risk_summary': {{'verdict': r.verdict, 'risk_score': r.risk_score,
                                   'confidence': r.confidence, 'breakdown': r.breakdown}},
                 'domain_reports': coalesce(d.reports, {empty_reports}),
                 'social_engineering_indicators': r.indicators,
                 'current_safe_steps': r.safe_steps,
                 'privacy_note': 'The message was PII-redacted locally before this model prompt.'}}) AS VARCHAR) AS payload,
  {q(','.join(routes))} AS routes
FROM rep r LEFT JOIN drl d USING (msg_id)"""


def _exports(out: dict, base: str) -> None:
    trace_steps = _trace_text_sql().strip()
    steps_list = "list({'step': step, 'status': status, 'detail': detail} ORDER BY k)"
    ev = ("list_transform(breakdown[1:5], lambda b: {'signal': b, 'why_it_matters': "
          f"{q(C.NOTE_WHY_RULE)}, 'severity': lower(verdict)}})")
    note = ("{'provider': " + q(C.NOTE_PROVIDER) + ", 'model': " + q(C.NOTE_MODEL) +
            ", 'fallback_used': true, 'status': 'fallback', 'fallback_reason': fallback_reason, "
            "'request_id': CAST(NULL AS VARCHAR), 'usage': CAST(NULL AS VARCHAR), "
            "'executive_summary': 'Classified this as ' || verdict || ' risk (' || CAST(risk_score AS VARCHAR) || '/100) using local rules.', "
            f"'user_explanation': {q(C.NOTE_EXPLANATION)}, 'recommended_priority': {_priority('verdict', 'situation')}, "
            f"'evidence': {ev}, 'questions': questions[1:3], "
            "'next_actions': list_transform(safe_steps[1:3], lambda x: replace(x, '**', '')), "
            f"'confidence_note': {q(C.NOTE_CONFIDENCE)}}}")
    guard = f"(contains(pk, '@') AND NOT contains(pk, {q(C.EMAIL_MASK)}))"
    out["report_exports"] = f"""{base},
{trace_rows_sql().strip()},
{trace_steps},
lks AS (SELECT msg_id, list({{'original': original, 'domain': domain}} ORDER BY pos) AS links FROM m_lk GROUP BY msg_id),
drl AS (SELECT msg_id, list({{'domain': domain, 'risk_score': risk_score, 'verdict': verdict,
          'indicators': indicators, 'detected_brands': detected_brands}} ORDER BY pos) AS reports FROM m_dr GROUP BY msg_id),
sct AS (SELECT msg_id, list({{'label': label, 'impact': CAST(impact AS INTEGER), 'source': source, 'severity': severity,
          'evidence': evidence, 'calculation': calculation}} ORDER BY pos) AS st FROM trp GROUP BY msg_id),
its AS (SELECT msg_id, {steps_list} AS steps FROM it GROUP BY msg_id)
SELECT msg_id, CAST(to_json({{
  'exported_at': strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'app': 'baitline',
  'situation': {_sit_label('situation')}, 'ai_route': 'Local Fallback',
  'report': {{'redacted_text': redacted_text,
    'links': coalesce(links, []::STRUCT(original VARCHAR, domain VARCHAR)[]),
    'domain_reports': coalesce(reports, []::STRUCT(domain VARCHAR, risk_score INTEGER, verdict VARCHAR, indicators VARCHAR[], detected_brands VARCHAR[])[]),
    'social_engineering_indicators': indicators, 'verdict': verdict, 'risk_score': risk_score,
    'confidence': confidence, 'breakdown': breakdown, 'score_trace': st, 'safe_steps': safe_steps,
    'ai_analysis': {note},
    'report_draft': CASE WHEN {guard} THEN {q(C.GUARDRAIL_BLOCKED)} ELSE pk END,
    'trace': steps,
    'extracted_text': CASE WHEN has_image THEN raw_text END}}}}) AS VARCHAR) AS export_json
FROM pk LEFT JOIN lks USING (msg_id) LEFT JOIN drl USING (msg_id) LEFT JOIN sct USING (msg_id)
  LEFT JOIN its USING (msg_id)"""
