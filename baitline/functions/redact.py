"""Redaction and privacy rules (R1-R11, R7 guardrail predicate).

All of these are built-in string functions, so they stay inside whole-stage
codegen and run map-side: a redaction pass never shuffles.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .regex import JS_SPACE, PY_SPACE, js_re, python_re
from .rule import lit, rule


#: One attempt at the start of a text, without backtracking.
_NINE_DIGITS = python_re(r"^(?:[^\d]*+\d){9}")


@rule
def redact_pii(text: str) -> str:
    """Email, SSN, national id, card, phone - in that order (order matters:
    placeholders of earlier passes shield digits from later ones).

    The passes run where they can match: the first needs an '@', the others nine digits at least
    (no placeholder holds either)."""
    (email, mask), *numbers = C.REDACTION_PASSES
    masked = f"CASE WHEN contains({text}, '@') THEN regexp_replace({text}, {lit(python_re(email))}, {lit(mask)}) ELSE {text} END"
    passes = masked
    for pattern, mask in numbers:
        passes = f"regexp_replace({passes}, {lit(python_re(pattern))}, {lit(mask)})"
    return f"CASE WHEN {text} RLIKE {lit(_NINE_DIGITS)} THEN {passes} ELSE {masked} END"


def redact_lite(text: Column) -> Column:
    """The cheaper browser rule set; phone runs before the id pattern."""
    out = F.regexp_replace(text, C.LITE_EMAIL_PATTERN, C.EMAIL_MASK)
    out = F.regexp_replace(out, js_re(C.LITE_PHONE_PATTERN), C.PHONE_MASK)
    return F.regexp_replace(out, C.LITE_ID_PATTERN, C.LITE_ID_MASK)


def mask_count(redacted: Column, mask: str) -> Column:
    """Number of placeholders of one kind in a redacted text."""
    return ((F.length(redacted) - F.length(F.replace(redacted, F.lit(mask), F.lit(""))))
            / F.lit(len(mask))).cast("int")


@rule
def leaks_pii(field: str) -> str:
    """An '@' survives while no e-mail placeholder is present in the field."""
    return f"(contains({field}, '@') AND NOT contains({field}, {lit(C.EMAIL_MASK)}))"


def text_preview(redacted: Column) -> Column:
    """R11 (history): first 140 chars of the stored redacted text."""
    stored = F.coalesce(F.nullif(redacted, F.lit("")), F.lit(C.SCREENSHOT_TEXT_MASK))
    return F.substring(stored, 1, C.PREVIEW_CHARS)


@rule
def ocr_preview(text: str) -> str:
    """R11 (OCR step): first 60 chars plus '...' when longer."""
    n = C.OCR_PREVIEW_CHARS
    return f"CASE WHEN length({text}) > {n} THEN concat(substring({text}, 1, {n}), '...') ELSE {text} END"


def strip_ws(text: Column) -> Column:
    """Trim white space at both ends as Python's ``str.strip`` does (Spark's trim strips spaces only)."""
    return F.regexp_replace(text, f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def strip_js(text: Column) -> Column:
    """Trim white space at both ends as a browser's ``trim`` does.

    The search over the text runs where an end is white, or one of the line ends before which ``$`` matches."""
    end = f"[{JS_SPACE}\\x{{85}}]"
    at_ends = F.substring(text, 1, 1).rlike(end) | F.substring(text, -1, 1).rlike(end)
    return F.when(at_ends, F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")).otherwise(text)
