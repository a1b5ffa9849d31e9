"""Persuasion signal rules.

Keyword lexicons are substring tests on the lower-cased redacted text;
brands are word matches. Everything is a built-in predicate evaluated in
the scan's projection.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .regex import occurring
from .rule import EMPTY, let, lit, present, rule, texts

# Word boundary that agrees across engines: not a letter, digit or '_'.
_EDGE_L = r"^|[^\p{L}\p{N}_]"
_EDGE_R = r"[^\p{L}\p{N}_]|$"

HIT_FIELDS = ["urgency", "brands", "financial", "data", "relationship"]
HIT_COLUMNS = [f"h_{f}" for f in HIT_FIELDS]


def _hits(low: str, keywords: list[str] | None) -> str:
    """Matched keywords of a lower-cased text in lexicon order, one filter over the lexicon; None:
    brands named as words (the substring test first keeps it cheap, and one fixed pattern of all
    brands is compiled once and not per row)."""
    if keywords is None:
        named = f"array_intersect(held, coalesce({occurring('low', C.BRANDS, _EDGE_L, _EDGE_R)}, {EMPTY}))"
        return let("low", low, let("held", f"filter({texts(C.BRANDS)}, b -> contains(low, b))",
                                   f"CASE WHEN size(held) > 0 THEN {named} ELSE held END"))
    return let("low", low, f"filter({texts(keywords)}, k -> contains(low, k))")


_NO_INDICATOR = "cast(array() AS array<struct<category: string, detail: string>>)"


def _indicators(hits: list[str]) -> str:
    """``array<struct<category, detail>>`` in category order; evidence is the first three
    hits (all brands for Brand Impersonation)."""
    pairs = []
    for (category, keywords, prefix), h in zip(C.SIGNAL_CATEGORIES, hits):
        shown = h if keywords is None else f"slice({h}, 1, 3)"
        pairs.append((f"size({h}) > 0", f"named_struct('category', {lit(category)}, "
                                        f"'detail', concat({lit(prefix)}, array_join({shown}, ', ')))"))
    return present(pairs, _NO_INDICATOR)


@rule
def detect_signals(text: str) -> str:
    """T1-T7 in one expression; the lower-cased text and the hits are bound once."""
    found = ", ".join(f"{lit(f)}, {_hits('lowered', k)}" for f, (_, k, _) in zip(HIT_FIELDS, C.SIGNAL_CATEGORIES))
    return let("lowered", f"lower({text})", let("h", f"named_struct({found})", _indicators([f"h.{f}" for f in HIT_FIELDS])))


def signal_hit_columns(low: str) -> dict[str, Column]:
    """{hit column: expression} over a lower-cased text, for ``withColumns`` (one projection)."""
    return {c: F.expr(_hits(low, k)) for c, (_, k, _) in zip(HIT_COLUMNS, C.SIGNAL_CATEGORIES)}


def indicators_from_columns() -> Column:
    return F.expr(_indicators(HIT_COLUMNS))


def add_signal_columns(df, text: str, out: str = "indicators"):
    """T1-T7 staged as one top-level column per category (each computed once)."""
    df = df.withColumn("_low", F.lower(text)).withColumns(signal_hit_columns("_low"))
    return df.withColumn(out, indicators_from_columns()).drop("_low")


def categories_text(indicators: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(indicators, lambda i: i["category"]), sep)


def hit_rows() -> Column:
    """T8 long form over the hit columns: ``array<struct<category, rank, keyword>>`` (inline it)."""
    return F.expr("concat(" + ", ".join(
        f"transform({h}, (k, i) -> named_struct('category', {lit(category)}, 'rank', i + 1, 'keyword', k))"
        for (category, _, _), h in zip(C.SIGNAL_CATEGORIES, HIT_COLUMNS)) + ")")
