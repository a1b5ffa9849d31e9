"""Safe steps, priority, questions and the offline analyst note.

The lookups are keyed by a handful of fixed situations, so they are CASE
expressions over literal arrays: no join, no shuffle.
"""
from __future__ import annotations

from .. import constants as C
from .rule import EMPTY, case, lit, rule, texts


@rule
def safe_steps(situation: str) -> str:
    """Four steps per known situation, two generic ones otherwise."""
    return case([(f"{situation} = {lit(s)}", texts(steps)) for s, steps in C.SAFE_STEPS.items()], texts(C.GENERIC_STEPS))


@rule
def priority(verdict: str, situation: str) -> str:
    """P2."""
    return case([(f"{situation} = 'compromised'", "'lockdown'"), (f"{verdict} = 'High'", "'urgent'"),
                 (f"{verdict} = 'Medium'", "'caution'")], "'monitor'")


@rule
def questions(situation: str) -> str:
    """Two clarifying questions per known situation, none otherwise."""
    return case([(f"{situation} = {lit(s)}", texts(qs)) for s, qs in C.QUESTIONS.items()], EMPTY)


def _evidence(signal: str, why: str, verdict: str) -> str:
    return f"named_struct('signal', {signal}, 'why_it_matters', {lit(why)}, 'severity', lower({verdict}))"


@rule
def offline_evidence(breakdown: str, reports: str, indicators: str, verdict: str) -> str:
    """First five breakdown lines, else a generic domain or text line."""
    from_lines = f"transform(slice({breakdown}, 1, 5), b -> {_evidence('b', C.NOTE_WHY_RULE, verdict)})"
    domain_line = f"array({_evidence(lit(C.NOTE_DOMAIN_SIGNAL), C.NOTE_DOMAIN_WHY, verdict)})"
    text_line = f"array({_evidence(lit(C.NOTE_TEXT_SIGNAL), C.NOTE_TEXT_WHY, verdict)})"
    return case([(f"size({breakdown}) > 0", from_lines), (f"size({reports}) > 0", domain_line),
                 (f"size({indicators}) > 0", text_line)], f"slice({text_line}, 1, 0)")


@rule
def next_actions(steps: str) -> str:
    """First three steps with '**' removed."""
    return f"transform(slice({steps}, 1, 3), s -> replace(s, '**', ''))"


@rule
def offline_reason(demo_offline: str) -> str:
    """Why a message has no live note."""
    return f"CASE WHEN coalesce({demo_offline}, false) THEN {lit(C.REASON_OFFLINE)} ELSE {lit(C.REASON_NO_RESPONSE)} END"


@rule
def offline_note(reason: str, situation: str, verdict: str, risk_score: str, breakdown: str, reports: str,
                 indicators: str, steps: str) -> str:
    """P5: the deterministic analyst note (union schema with the live note)."""
    fields = {
        "provider": lit(C.NOTE_PROVIDER), "model": lit(C.NOTE_MODEL), "fallback_used": "true", "status": "'fallback'",
        "fallback_reason": reason, "request_id": "cast(NULL AS string)", "usage": "cast(NULL AS string)",
        "executive_summary": f"concat('Classified this as ', {verdict}, ' risk (', cast({risk_score} AS string), "
                             "'/100) using local rules.')",
        "user_explanation": lit(C.NOTE_EXPLANATION), "recommended_priority": priority.sql(verdict, situation),
        "evidence": offline_evidence.sql(breakdown, reports, indicators, verdict),
        "questions": f"slice({questions.sql(situation)}, 1, 3)", "next_actions": next_actions.sql(steps),
        "confidence_note": lit(C.NOTE_CONFIDENCE)}
    return "named_struct(" + ", ".join(f"{lit(n)}, {v}" for n, v in fields.items()) + ")"
