"""The tool surface.

Seven named tools and their aliases, for DataFrame users (``call_tool``) and as SQL
functions with default arguments (``register_sql_functions``): ``SELECT redact_pii(text)
FROM t`` is inlined as a built-in expression, no Python UDF. The body of every function is
the text of the rule that the pipeline runs; nothing is written twice.

Two table functions give rows instead of arrays, for lateral joins:
``SELECT m.id, r.* FROM messages m, LATERAL link_reports(m.text) r``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from . import domains as D
from . import links as L
from . import plan as P
from . import redact as R
from . import report as G
from . import scoring as K
from . import signals as T

LINKS = "ARRAY<STRUCT<original: STRING, domain: STRING>>"
REPORT = ("STRUCT<domain: STRING, risk_score: INT, verdict: STRING, indicators: ARRAY<STRING>, "
          "detected_brands: ARRAY<STRING>>")
INDICATORS = "ARRAY<STRUCT<category: STRING, detail: STRING>>"
SCORE = ("STRUCT<risk_score: INT, verdict: STRING, confidence: INT, breakdown: ARRAY<STRING>, "
         "score_trace: ARRAY<STRUCT<label: STRING, impact: INT, source: STRING, severity: STRING, evidence: STRING, "
         "calculation: STRING>>, max_domain_score: INT, top_domain: STRING, text_sum: INT>")


@dataclass(frozen=True)
class Tool:
    """Parameters as (name, type, default as SQL), the result's type, and the body over the parameters."""
    parameters: list[tuple[str, str, str]]
    returns: str
    body: str

    def signature(self) -> str:
        return ", ".join(f"{n} {t} DEFAULT {d}" for n, t, d in self.parameters)


def _none(kind: str) -> str:
    return f"cast(array() AS {kind})"


_TEXT = [("text", "STRING", "''")]
TOOLS: dict[str, Tool] = {
    "redact_pii": Tool(_TEXT, "STRING", R.redact_pii.sql("text")),
    "extract_links": Tool(_TEXT, LINKS, L.extract_links.sql("text")),
    "inspect_domain_pattern": Tool([("domain", "STRING", "''")], REPORT, D.inspect_domain.sql("domain")),
    "detect_social_engineering": Tool(_TEXT, INDICATORS, T.detect_signals.sql("text")),
    "score_risk": Tool([("domain_reports", f"ARRAY<{REPORT}>", _none(f"ARRAY<{REPORT}>")),
                        ("text_indicators", INDICATORS, _none(INDICATORS))],
                       SCORE, K.score_risk.sql("domain_reports", "text_indicators")),
    # the verdict argument is accepted and has no effect
    "generate_safe_steps": Tool([("verdict", "STRING", "'Low'"), ("situation", "STRING", "'before_click'")],
                                "ARRAY<STRING>", P.safe_steps.sql("situation")),
    "generate_report_draft": Tool([("text", "STRING", "''"), ("redacted_text", "STRING", "''"), ("risk_score", "INT", "0"),
                                   ("indicators", INDICATORS, _none(INDICATORS)),
                                   ("safe_steps", "ARRAY<STRING>", _none("ARRAY<STRING>"))],
                                  "STRING", G.case_packet.sql("redacted_text", "risk_score", "indicators", "safe_steps")),
}
ALIASES = {alias: name for name, alias in C.TOOL_ALIASES.items()}

#: Further functions: the verdict of a score, and rows for lateral joins.
SCALARS = {"risk_verdict": Tool([("score", "INT", "0")], "STRING", K.score_verdict.sql("score"))}
TABLES = {
    "link_reports": Tool([("text", "STRING", "''")], "pos INT, original STRING, domain STRING, risk_score INT, verdict STRING, "
                         "indicators ARRAY<STRING>, detected_brands ARRAY<STRING>",
                         "SELECT pos + 1, link.original, r.domain, r.risk_score, r.verdict, r.indicators, r.detected_brands "
                         f"FROM (SELECT pos, link, {D.inspect_domain.sql('link.domain')} AS r "
                         f"FROM (SELECT posexplode({L.extract_links.sql('text')}) AS (pos, link)))"),
    "text_signals": Tool([("text", "STRING", "''")], "pos INT, category STRING, detail STRING",
                         "SELECT pos + 1, signal.category, signal.detail "
                         f"FROM (SELECT posexplode({T.detect_signals.sql('text')}) AS (pos, signal))"),
}


def resolve_tool(name: str) -> Tool:
    canonical = name if name in TOOLS else ALIASES.get(name)
    if canonical is None:
        raise ValueError(f"Unknown tool: {name}")
    return TOOLS[canonical]


def call_tool(name: str, **operands: Column) -> Column:
    """A tool on columns, by name or alias; operands that are left out get their defaults."""
    tool = resolve_tool(name)
    known = {n for n, _, _ in tool.parameters}
    if set(operands) - known:
        raise ValueError(f"{name} has no operand {sorted(set(operands) - known)}")
    bound = F.struct(*[operands.get(n, F.expr(d)).cast(t).alias(n) for n, t, d in tool.parameters])
    # parameters become fields of a bound struct, so a name never meets a column of the table
    body = tool.body
    for n, _, _ in reversed(tool.parameters):
        body = f"get(transform(array(given.{n}), {n} -> {body}), 0)"
    return F.get(F.call_function("transform", F.array(bound), F.expr(f"given -> {body}")), F.lit(0))


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register the tools, their aliases, ``risk_verdict`` and the table functions for this session."""
    made = []
    for name, tool in (TOOLS | SCALARS).items():
        for fn in [name, *([C.TOOL_ALIASES[name]] if name in C.TOOL_ALIASES else [])]:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {fn}({tool.signature()}) RETURNS {tool.returns} RETURN {tool.body}")
            made.append(fn)
    for name, tool in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({tool.signature()}) RETURNS TABLE({tool.returns}) "
                  f"RETURN {tool.body}")
        made.append(name)
    return made
