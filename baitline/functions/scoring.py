"""Risk synthesis rules (K1-K13) over a message's domain reports and indicators.

Inputs are the per-message arrays, so the max/argmax/sums are array
aggregates inside the row: no groupBy, no shuffle. ``SCORE`` is the only copy
of the rules: its levels become columns of a plan, or one nested expression
(``score_risk``, the tool).
"""
from __future__ import annotations

from .. import constants as C
from .rule import Stages, case, lit, present, rule


def _by_category(category: str, values: dict, default: str) -> str:
    return case([(f"{category} = {lit(c)}", v) for c, v in values.items()], default)


def _impact(category: str) -> str:
    """K1."""
    return _by_category(category, {c: i for c, (i, _) in C.CATEGORY_WEIGHTS.items()}, C.DEFAULT_WEIGHT[0])


def _severity(category: str) -> str:
    """K2."""
    return _by_category(category, {c: lit(s) for c, (_, s) in C.CATEGORY_WEIGHTS.items()}, lit(C.DEFAULT_WEIGHT[1]))


def _band(score: str, names: tuple[str, str, str]) -> str:
    return case([(f"{score} >= {C.SCORE_HIGH}", lit(names[0])), (f"{score} >= {C.SCORE_MEDIUM}", lit(names[1]))], lit(names[2]))


def _level(score: str) -> str:
    """K3."""
    return _band(score, ("high", "medium", "low"))


@rule
def score_verdict(score: str) -> str:
    """K10."""
    return _band(score, ("High", "Medium", "Low"))


def _boost(m: str, n: str) -> str:
    """K7."""
    return case([(f"{m} >= 90", f"4 + least({n}, 3)"), (f"{m} >= 70", f"6 + least({n} * 2, 8)"),
                 (f"{m} >= 35", f"10 + least({n} * 3, 18)")], f"least({n} * 2, 8)")


def _cap(m: str, n: str) -> str:
    """K8."""
    return case([(f"{m} >= 95 AND {n} >= 4", 100), (f"{m} >= 90", 98), (f"{m} >= 70", 96), (f"{m} >= 35", 88)], "85")


def _item(label: str, impact: str, source: str, severity: str, evidence: str, calculation: str) -> str:
    return (f"named_struct('label', {label}, 'impact', cast({impact} AS int), 'source', {lit(source)}, "
            f"'severity', {severity}, 'evidence', {evidence}, 'calculation', {calculation})")


_NO_ITEM = ("cast(array() AS array<struct<label: string, impact: int, source: string, severity: string, "
            "evidence: string, calculation: string>>)")
_DOMAIN_ITEM = _item(
    lit(C.TRACE_DOMAIN_LABEL), "{max_domain_score}", "domain_pattern", _level("{max_domain_score}"),
    "concat(coalesce({_top}.domain, 'suspicious domain'), ': ', CASE WHEN size({_top}.indicators) > 0 "
    f"THEN array_join(slice({{_top}}.indicators, 1, 2), '; ') ELSE {lit(C.TRACE_DOMAIN_DEFAULT_EVIDENCE)} END)",
    lit(C.TRACE_DOMAIN_CALC))
_TEXT_ITEM = _item(
    "coalesce(x.category, 'Text Signal')", _impact("x.category"), "message_text", _severity("x.category"),
    f"coalesce(x.detail, {lit(C.TRACE_TEXT_DEFAULT_EVIDENCE)})",
    f"concat('+', cast({_impact('x.category')} AS string), ' for this matched social engineering signal.')")
_COMBO_ITEM = _item(lit(C.TRACE_COMBO_LABEL), "{risk_score} - {_before}", "risk_synthesis", _level("{risk_score}"),
                    lit(C.TRACE_COMBO_EVIDENCE), lit(C.TRACE_COMBO_CALC))
_BASELINE_ITEM = _item(lit(C.TRACE_BASELINE_LABEL), "0", "local_rules", "'low'", lit(C.TRACE_BASELINE_EVIDENCE),
                       lit(C.TRACE_BASELINE_CALC))

#: Inputs: domain_reports, indicators.
SCORE = Stages(
    {   # K4, K5: what the arrays say
        "max_domain_score": "cast(greatest(coalesce(array_max(transform({domain_reports}, x -> x.risk_score)), 0), 0) AS int)",
        "_n": "size({indicators})",
        "_n_reports": "size({domain_reports})",
        "text_sum": f"aggregate({{indicators}}, 0, (acc, x) -> acc + {_impact('x.category')})",
        "_cats": "transform({indicators}, x -> x.category)",
    }, {
        "_top": "get(filter({domain_reports}, x -> x.risk_score = {max_domain_score}), 0)",
        "_before": "greatest({text_sum}, {max_domain_score})",
        "_lines": present([("{max_domain_score} > 50", lit(C.BREAKDOWN_DOMAIN)), *[
            (f"array_contains({{_cats}}, {lit(c)})", lit(line)) for c, line in C.BREAKDOWN_LINES]]),
        # K6
        "confidence": "cast(least(55 + CASE WHEN {_n_reports} > 0 THEN 15 ELSE 0 END "
                      "+ CASE WHEN {max_domain_score} >= 70 THEN 15 ELSE 0 END + least({_n} * 8, 24), 98) AS int)",
    }, {    # K9
        "risk_score": "cast(least(CASE WHEN {max_domain_score} > 0 THEN CASE WHEN {_n} >= 2 "
                      f"THEN least({{_before}} + {_boost('{max_domain_score}', '{_n}')}, "
                      f"{_cap('{max_domain_score}', '{_n}')}) ELSE {{_before}} END "
                      "ELSE least({text_sum}, 85) END, 100) AS int)",
    }, {    # K10-K12
        "verdict": _band("{risk_score}", ("High", "Medium", "Low")),
        "breakdown": f"CASE WHEN size({{_lines}}) = 0 THEN array({lit(C.BREAKDOWN_NONE)}) ELSE {{_lines}} END",
        "score_trace": f"concat(CASE WHEN {{_top}} IS NOT NULL AND {{max_domain_score}} > 0 THEN array({_DOMAIN_ITEM}) ELSE {_NO_ITEM} END, "
                       f"transform({{indicators}}, x -> {_TEXT_ITEM}), "
                       f"CASE WHEN {{max_domain_score}} > 0 AND {{_n}} >= 2 THEN array({_COMBO_ITEM}) ELSE {_NO_ITEM} END, "
                       f"CASE WHEN size({{_lines}}) = 0 THEN array({_BASELINE_ITEM}) ELSE {_NO_ITEM} END)",
        "top_domain": "CASE WHEN {max_domain_score} > 0 THEN {_top}.domain END",
    })
_INNER = ["_n", "_n_reports", "_top", "_cats", "_before", "_lines"]
SCORE_FIELDS = ["risk_score", "verdict", "confidence", "breakdown", "score_trace", "max_domain_score", "top_domain", "text_sum"]


def add_score_columns(df, reports: str = "domain_reports", indicators: str = "indicators"):
    """K1-K12 as columns, one level a projection.

    Intermediate results are plain columns (not struct fields) so Catalyst keeps
    each computed once: field accesses on a struct constructor are inlined by the
    optimizer, which would copy the per-link domain expressions into every use.
    """
    return SCORE.add(df, {"domain_reports": reports, "indicators": indicators}).drop(*_INNER)


@rule
def score_risk(reports: str, indicators: str) -> str:
    """The same levels as one expression."""
    return SCORE.nested({"domain_reports": reports, "indicators": indicators}, SCORE_FIELDS)
