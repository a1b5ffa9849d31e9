"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark side and set-based: links are unnested to
rows, domain reports are computed per row and aggregated back per message with
GROUP BY, signal hits use DuckDB list lambdas, score traces are UNION ALL rows.
Only the fixed rule values (from ``constants``) and the ``messages`` view
expressions are shared. Each function returns one self-contained statement.
"""
from __future__ import annotations

from .. import constants as C
from ..functions.regex import JS_SPACE, PY_SPACE, python_re
from ..sources.messages import view_sql


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


WS = f"^[{PY_SPACE}]+|[{PY_SPACE}]+$"
JS_WS = f"^[{JS_SPACE}]+|[{JS_SPACE}]+$"
BRACKET_OK = r"^[^\[\]]*\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\][^\[\]]*$"


def redact_sql(col: str) -> str:
    out = col
    for pattern, mask in C.REDACTION_PASSES:
        out = f"regexp_replace({out}, {q(python_re(pattern))}, {q(mask)}, 'g')"
    return out


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, {q(WS)}, '', 'g')"


def trim_sql(col: str) -> str:
    return f"regexp_replace({col}, {q(JS_WS)}, '', 'g')"


def _case_first(pairs, default="NULL") -> str:
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
    return f"CASE {whens} ELSE {default} END"


def screenshot_sql(ocr: str | None = None) -> str:
    pairs = [(f"contains(upper(image), {q(k)})", q(t)) for k, t in C.OCR_TEXTS]
    pairs.append(("coalesce(demo_offline, false)", q(C.OCR_DEFAULT_TEXT)))
    if ocr:
        pairs.append((f"{ocr} IS NOT NULL", ocr))
    hint = " OR ".join(f"contains(lower(image), {q(w)})" for w in C.OCR_HINT_WORDS)
    pairs.append((hint, q(C.OCR_TEXTS[0][1])))
    return _case_first(pairs, q(C.OCR_DEFAULT_TEXT))


def valid_sql() -> str:
    blank = f"(text IS NULL OR {strip_sql('text')} = '')"
    img = "(image IS NOT NULL AND image <> '')"
    sits = ", ".join(q(s) for s in C.SITUATIONS)
    return f"(NOT ({blank} AND NOT {img}) AND situation IN ({sits}))"


def reject_sql() -> str:
    blank = f"(text IS NULL OR {strip_sql('text')} = '')"
    img = "(image IS NOT NULL AND image <> '')"
    sits = ", ".join(q(s) for s in C.SITUATIONS)
    return (f"CASE WHEN {blank} AND NOT {img} THEN "
            f"{q('Either message text or screenshot image must be provided.')} "
            f"WHEN situation IS NULL OR situation NOT IN ({sits}) THEN "
            f"{q('Invalid situation. Must be one of before_click, clicked_only, compromised')} END")


# --- domain reports over a relation with columns (key..., domain) ------------

def domain_report_ctes(prefix: str, source: str) -> str:
    """CTEs ``{prefix}_d1.. {prefix}_dr`` adding risk_score, verdict, indicators,
    detected_brands to every row of ``source`` (which has a ``domain`` column)."""
    brands = qlist(C.BRANDS)
    tld_case = _case_first([(f"ends_with(d, {q(t)})", q(t)) for t in C.SUSPICIOUS_TLDS])
    typos = "[" + ", ".join("{'p': %s, 'b': %s}" % (q(p), q(b)) for p, b in C.TYPO_PATTERNS) + "]"
    return f"""
{prefix}_d1 AS (
  SELECT *, lower(domain) AS d,
    list_filter(string_split_regex(lower(domain), '[^a-z0-9]+'), lambda t: t <> '') AS toks,
    string_split(lower(domain), '.') AS parts
  FROM {source}
),
{prefix}_d2 AS (
  SELECT *,
    ' ' || array_to_string(toks, ' ') || ' ' AS padded,
    array_to_string(list_filter(string_split_regex(
      CASE WHEN len(parts) >= 2 THEN parts[len(parts) - 1] ELSE parts[1] END,
      '[^a-z0-9]+'), lambda t: t <> ''), ' ') AS main_key,
    {tld_case} AS tld,
    length(d) - length(replace(d, '-', '')) AS hyphens,
    length(regexp_replace(d, '[^\\p{{Nd}}]', '', 'g')) AS digits,
    list_transform(list_filter({typos}, lambda x: contains(d, x.p)), lambda x: x.b) AS typos
  FROM {prefix}_d1
),
{prefix}_d3 AS (
  SELECT *,
    list_filter({brands}, lambda b: contains(padded, ' ' || b || ' ') AND main_key <> b) AS detected_brands
  FROM {prefix}_d2
),
{prefix}_dr AS MATERIALIZED (
  SELECT * EXCLUDE (toks, parts, padded, main_key, raw_score),
    CAST(least(raw_score, 100) AS INTEGER) AS risk_score,
    CASE WHEN least(raw_score, 100) >= {C.DOMAIN_HIGH} THEN 'High'
         WHEN least(raw_score, 100) >= {C.DOMAIN_MEDIUM} THEN 'Medium' ELSE 'Low' END AS verdict,
    list_concat(
      CASE WHEN tld IS NOT NULL THEN ['Suspicious top-level domain: ' || tld] ELSE []::VARCHAR[] END,
      list_transform(detected_brands, lambda b: 'Impersonates brand ''' || b || ''' in a suspicious domain layout'),
      CASE WHEN hyphens > 1 THEN ['Contains multiple hyphens, typical of phishing domain naming patterns'] ELSE []::VARCHAR[] END,
      CASE WHEN digits > 3 THEN ['Contains multiple digits, often used to bypass spam filters'] ELSE []::VARCHAR[] END,
      list_transform(typos, lambda b: 'Typosquatting attempt mimicking ''' || b || '''')
    ) AS indicators
  FROM (
    SELECT *,
      (CASE WHEN tld IS NOT NULL THEN {C.TLD_POINTS} ELSE 0 END
       + len(detected_brands) * {C.BRAND_POINTS}
       + CASE WHEN hyphens > 1 THEN {C.HYPHEN_POINTS} ELSE 0 END
       + CASE WHEN digits > 3 THEN {C.DIGIT_POINTS} ELSE 0 END
       + len(typos) * {C.TYPO_POINTS}) AS raw_score
    FROM {prefix}_d3
  )
)"""


def link_ctes(prefix: str, source: str, key: str, text: str) -> str:
    """``{prefix}_lk(key, pos, original, domain)``: kept links, 1-based position."""
    url = q(python_re(C.URL_PATTERN))
    return f"""
{prefix}_u AS (
  SELECT {key}, unnest(urls) AS original, generate_subscripts(urls, 1) AS raw_pos
  FROM (SELECT {key}, regexp_extract_all({text}, {url}, 1) AS urls FROM {source})
),
{prefix}_n AS (
  SELECT *, regexp_extract(CASE WHEN starts_with(original, 'http') THEN original
                                ELSE 'http://' || original END, '^https?://([^/?#]*)', 1) AS netloc
  FROM {prefix}_u
),
{prefix}_lk AS MATERIALIZED (
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY raw_pos) AS INTEGER) AS pos,
         original, domain
  FROM (
    SELECT *, regexp_replace(split_part(lower(netloc), ':', 1), '^www[.]', '') AS domain
    FROM {prefix}_n
    WHERE (NOT (contains(netloc, '[') OR contains(netloc, ']')) OR regexp_matches(netloc, {q(BRACKET_OK)}))
      AND translate(netloc, {q(C.NFKC_DELIMITERS)}, '') = netloc
  ) WHERE domain <> ''
)"""


def signal_ctes(prefix: str, source: str, key: str, text: str) -> str:
    """``{prefix}_sg``: hit lists and category columns per row of ``source``."""
    def kw(name, words):
        return f"list_filter({qlist(words)}, lambda k: contains(low, k)) AS {name}"
    edge_l, edge_r = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
    brand_items = ", ".join(
        f"CASE WHEN contains(low, {q(b)}) AND regexp_matches(low, {q(edge_l + b + edge_r)}) "
        f"THEN {q(b)} END" for b in C.BRANDS)
    brand = f"list_filter([{brand_items}], lambda x: x IS NOT NULL) AS h_brand"
    return f"""
{prefix}_h AS (
  SELECT {key}, {kw('h_urg', C.URGENCY_KEYWORDS)}, {brand},
         {kw('h_fin', C.FINANCIAL_KEYWORDS)}, {kw('h_data', C.DATA_KEYWORDS)},
         {kw('h_rel', C.RELATIONSHIP_KEYWORDS)}
  FROM (SELECT {key}, lower({text}) AS low FROM {source})
),
{prefix}_sg AS MATERIALIZED (
  SELECT *,
    list_filter([
      CASE WHEN len(h_urg) > 0 THEN {{'category': {q(C.URGENCY)}, 'detail': 'High urgency words detected: ' || array_to_string(h_urg[1:3], ', ')}} END,
      CASE WHEN len(h_brand) > 0 THEN {{'category': {q(C.BRAND)}, 'detail': 'Claimed source: ' || array_to_string(h_brand, ', ')}} END,
      CASE WHEN len(h_fin) > 0 THEN {{'category': {q(C.FINANCIAL)}, 'detail': 'Financial or delivery terminology detected: ' || array_to_string(h_fin[1:3], ', ')}} END,
      CASE WHEN len(h_data) > 0 THEN {{'category': {q(C.DATA)}, 'detail': 'Account verification request: ' || array_to_string(h_data[1:3], ', ')}} END,
      CASE WHEN len(h_rel) > 0 THEN {{'category': {q(C.RELATIONSHIP)}, 'detail': 'Trust-building or isolation language detected: ' || array_to_string(h_rel[1:3], ', ')}} END
    ], lambda x: x IS NOT NULL) AS indicators,
    (CASE WHEN len(h_urg) > 0 THEN 14 ELSE 0 END + CASE WHEN len(h_brand) > 0 THEN 12 ELSE 0 END
     + CASE WHEN len(h_fin) > 0 THEN 14 ELSE 0 END + CASE WHEN len(h_data) > 0 THEN 16 ELSE 0 END
     + CASE WHEN len(h_rel) > 0 THEN 22 ELSE 0 END) AS text_sum
  FROM {prefix}_h
)"""


def _steps_case(col: str) -> str:
    pairs = [(f"{col} = {q(s)}", qlist(steps)) for s, steps in C.SAFE_STEPS.items()]
    return _case_first(pairs, qlist(C.GENERIC_STEPS))


def _questions_case(col: str) -> str:
    pairs = [(f"{col} = {q(s)}", qlist(qs)) for s, qs in C.QUESTIONS.items()]
    return _case_first(pairs, "[]::VARCHAR[]")


def base_ctes(messages_sql: str | None = None) -> str:
    """The full investigation per accepted message as CTEs ending in ``rep``.

    ``messages_sql`` replaces the messages view (it must yield msg_id, text,
    situation, image, demo_offline and any carried columns)."""
    bd = [(f"m > 50", q(C.BREAKDOWN_DOMAIN))] + [
        (f"len({h}) > 0", q(line)) for h, (_, line) in zip(["h_urg", "h_brand", "h_fin", "h_data"], C.BREAKDOWN_LINES)]
    breakdown_items = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in bd)
    return f"""WITH msgs AS (
{messages_sql or view_sql('events')}
),
acc AS (SELECT * FROM msgs WHERE {valid_sql()}),
src AS (
  SELECT *, (image IS NOT NULL AND image <> '') AS has_image,
    CASE WHEN image IS NOT NULL AND image <> '' THEN {screenshot_sql()}
         ELSE coalesce(text, '') END AS raw_text
  FROM acc
),
red AS MATERIALIZED (SELECT *, {redact_sql('raw_text')} AS redacted_text FROM src),
{link_ctes('m', 'red', 'msg_id', 'raw_text')},
{domain_report_ctes('m', 'm_lk')},
dagg AS MATERIALIZED (
  SELECT msg_id, count(*) AS n_reports, max(risk_score) AS max_score,
    first(domain ORDER BY risk_score DESC, pos) AS top_domain,
    first(indicators ORDER BY risk_score DESC, pos) AS top_indicators,
    count(*) FILTER (WHERE verdict = 'High') AS n_high,
    list(domain ORDER BY pos) AS domains,
    list(domain ORDER BY pos) FILTER (WHERE verdict = 'High') AS high_domains,
    list(domain || ' (' || CAST(risk_score AS VARCHAR) || '/100)' ORDER BY pos) AS domain_scores
  FROM m_dr GROUP BY msg_id
),
{signal_ctes('s', 'red', 'msg_id', 'redacted_text')},
sc0 AS (
  SELECT red.*, s_sg.* EXCLUDE (msg_id),
    coalesce(dagg.n_reports, 0) AS n_reports, coalesce(dagg.n_high, 0) AS n_high,
    greatest(coalesce(dagg.max_score, 0), 0) AS m,
    dagg.top_domain, dagg.top_indicators, dagg.domains, dagg.high_domains, dagg.domain_scores,
    len(s_sg.indicators) AS n
  FROM red JOIN s_sg USING (msg_id) LEFT JOIN dagg USING (msg_id)
),
sc1 AS (
  SELECT *, greatest(text_sum, m) AS before_combo,
    CASE WHEN m >= 90 THEN 4 + least(n, 3) WHEN m >= 70 THEN 6 + least(2 * n, 8)
         WHEN m >= 35 THEN 10 + least(3 * n, 18) ELSE least(2 * n, 8) END AS boost,
    CASE WHEN m >= 95 AND n >= 4 THEN 100 WHEN m >= 90 THEN 98 WHEN m >= 70 THEN 96
         WHEN m >= 35 THEN 88 ELSE 85 END AS cap
  FROM sc0
),
sc AS MATERIALIZED (
  SELECT *,
    CAST(least(100, CASE WHEN m > 0 THEN (CASE WHEN n >= 2 THEN least(before_combo + boost, cap)
                                                ELSE before_combo END)
                         ELSE least(text_sum, 85) END) AS INTEGER) AS risk_score,
    CAST(least(98, 55 + CASE WHEN n_reports > 0 THEN 15 ELSE 0 END + CASE WHEN m >= 70 THEN 15 ELSE 0 END
                   + least(8 * n, 24)) AS INTEGER) AS confidence,
    list_filter([{breakdown_items}], lambda x: x IS NOT NULL) AS bd_lines
  FROM sc1
),
rep AS MATERIALIZED (
  SELECT *,
    CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 35 THEN 'Medium' ELSE 'Low' END AS verdict,
    CASE WHEN len(bd_lines) = 0 THEN [{q(C.BREAKDOWN_NONE)}] ELSE bd_lines END AS breakdown,
    {_steps_case('situation')} AS safe_steps,
    {_questions_case('situation')} AS questions,
    CASE WHEN coalesce(demo_offline, false) THEN {q(C.REASON_OFFLINE)} ELSE {q(C.REASON_NO_RESPONSE)} END AS fallback_reason
  FROM sc
)"""


def trace_rows_sql() -> str:
    """Score trace items as rows (msg_id, sec, idx, label, impact, source, severity,
    evidence, calculation) from ``rep``."""
    sev = lambda x: f"CASE WHEN {x} >= 70 THEN 'high' WHEN {x} >= 35 THEN 'medium' ELSE 'low' END"
    weights = " ".join(f"WHEN {q(c)} THEN {w}" for c, (w, _) in C.CATEGORY_WEIGHTS.items())
    sevs = " ".join(f"WHEN {q(c)} THEN {q(s)}" for c, (_, s) in C.CATEGORY_WEIGHTS.items())
    return f"""
tr AS (
  SELECT msg_id, 0 AS sec, 0 AS idx, {q(C.TRACE_DOMAIN_LABEL)} AS label, m AS impact,
    'domain_pattern' AS source, {sev('m')} AS severity,
    top_domain || ': ' || CASE WHEN len(top_indicators) > 0 THEN array_to_string(top_indicators[1:2], '; ')
                              ELSE {q(C.TRACE_DOMAIN_DEFAULT_EVIDENCE)} END AS evidence,
    {q(C.TRACE_DOMAIN_CALC)} AS calculation
  FROM rep WHERE m > 0
  UNION ALL
  SELECT msg_id, 1, i, ind.category, CASE ind.category {weights} ELSE 10 END, 'message_text',
    CASE ind.category {sevs} ELSE 'low' END, ind.detail,
    '+' || CAST(CASE ind.category {weights} ELSE 10 END AS VARCHAR) || ' for this matched social engineering signal.'
  FROM (SELECT msg_id, unnest(indicators) AS ind, generate_subscripts(indicators, 1) AS i FROM rep)
  UNION ALL
  SELECT msg_id, 2, 0, {q(C.TRACE_COMBO_LABEL)}, risk_score - before_combo, 'risk_synthesis',
    {sev('risk_score')}, {q(C.TRACE_COMBO_EVIDENCE)}, {q(C.TRACE_COMBO_CALC)}
  FROM rep WHERE m > 0 AND n >= 2
  UNION ALL
  SELECT msg_id, 3, 0, {q(C.TRACE_BASELINE_LABEL)}, 0, 'local_rules', 'low',
    {q(C.TRACE_BASELINE_EVIDENCE)}, {q(C.TRACE_BASELINE_CALC)}
  FROM rep WHERE len(bd_lines) = 0
),
trp AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY sec, idx) AS INTEGER) AS pos FROM tr
)"""


def packet_sql() -> str:
    brand = ("upper(coalesce(replace(list_filter(indicators, lambda i: i.category = "
             f"{q(C.BRAND)})[1].detail, 'Claimed source: ', ''), 'Unknown'))")
    level = "CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END"
    signals = (f"CASE WHEN len(indicators) > 0 THEN array_to_string(list_transform(indicators, "
               f"lambda i: i.category), ', ') ELSE {q(C.PACKET_NO_SIGNALS)} END")
    first = f"coalesce(safe_steps[1], {q(C.DEFAULT_FIRST_MOVE)})"
    parts = [q(C.PACKET_HEADER), f"'Risk: ' || {level} || ' (' || CAST(risk_score AS VARCHAR) || '/100)'",
             f"'Target brand: ' || {brand}", f"'Signals: ' || {signals}", q(C.PACKET_PRIVACY), "''",
             "'First safe move:'", first, "''", "'Anonymized suspicious content:'", "redacted_text",
             "''", "'Requested action:'", q(C.PACKET_ACTION)]
    return " || chr(10) || ".join(parts)


def target_brand_sql() -> str:
    return ("upper(coalesce(replace(list_filter(indicators, lambda i: i.category = "
            f"{q(C.BRAND)})[1].detail, 'Claimed source: ', ''), 'Unknown'))")
