"""Offline domain inspection rules.

Inspection is staged so that each finding is computed once: ``_prep`` splits the
domain, ``_flags`` tests it (matched TLD, impersonated brands, hyphen and digit
counts, typo patterns) and ``_report`` turns the findings into
``struct<domain, risk_score, verdict, indicators, detected_brands>``.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .rule import EMPTY, case, let, lit, rule, texts


def _tokens(low: str) -> str:
    """Alphanumeric runs of a lower-case text, joined by single spaces."""
    return f"trim(regexp_replace({low}, '[^a-z0-9]+', ' '))"


def _brand_key(brand: str) -> str:
    return " ".join(t for t in re.split(r"[^a-z0-9]+", brand.lower()) if t)


def _prep(domain: str) -> str:
    """Values that the tests reuse: lower case, spaced tokens, tokens of the registrable label."""
    label = f"substring_index(substring_index(lower({domain}), '.', -2), '.', 1)"
    return (f"named_struct('d', lower({domain}), 'padded', concat(' ', {_tokens(f'lower({domain})')}, ' '), "
            f"'main_key', concat(' ', {_tokens(label)}, ' '))")


def _flags(p: str) -> str:
    # D3 + D5: the brand's tokens occur contiguously and the registrable label is not the brand itself.
    if [_brand_key(b) for b in C.BRANDS] != C.BRANDS:
        raise ValueError("a brand is written as its tokens, with single spaces")
    keys = texts([f" {b} " for b in C.BRANDS])
    brands = f"transform(filter({keys}, b -> contains({p}.padded, b) AND {p}.main_key != b), b -> trim(b))"
    if any(t[0] != "." or "." in t[1:] for t in C.SUSPICIOUS_TLDS):
        raise ValueError("a top-level domain is a dot and a label")
    end = f"concat('.', substring_index({p}.d, '.', -1))"
    tld = f"CASE WHEN contains({p}.d, '.') AND array_contains({texts(C.SUSPICIOUS_TLDS)}, {end}) THEN {end} END"
    patterns = ", ".join(f"named_struct('found', {lit(found)}, 'brand', {lit(b)})" for found, b in C.TYPO_PATTERNS)
    typos = f"transform(filter(array({patterns}), t -> contains({p}.d, t.found)), t -> t.brand)"
    return (f"named_struct('domain', {p}.d, 'tld', {tld}, 'brands', {brands}, "
            f"'hyphens', length({p}.d) - length(replace({p}.d, '-', '')), "
            f"'digits', length({p}.d) - length(regexp_replace({p}.d, {lit(chr(92) + 'p{Nd}')}, '')), 'typos', {typos})")


def _report(f: str) -> str:
    raw = (f"CASE WHEN {f}.tld IS NOT NULL THEN {C.TLD_POINTS} ELSE 0 END + size({f}.brands) * {C.BRAND_POINTS} "
           f"+ CASE WHEN {f}.hyphens > 1 THEN {C.HYPHEN_POINTS} ELSE 0 END "
           f"+ CASE WHEN {f}.digits > 3 THEN {C.DIGIT_POINTS} ELSE 0 END + size({f}.typos) * {C.TYPO_POINTS}")
    score = f"cast(least({raw}, 100) AS int)"
    verdict = case([(f"{score} >= {C.DOMAIN_HIGH}", "'High'"), (f"{score} >= {C.DOMAIN_MEDIUM}", "'Medium'")], "'Low'")

    def only_if(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN array({value}) ELSE {EMPTY} END"
    indicators = (
        f"concat({only_if(f'{f}.tld IS NOT NULL', f'concat({lit(C.TLD_TEXT)}, {f}.tld)')}, "
        f"transform({f}.brands, b -> concat({lit(C.IMPERSONATES_TEXT[0])}, b, {lit(C.IMPERSONATES_TEXT[1])})), "
        f"{only_if(f'{f}.hyphens > 1', lit(C.HYPHENS_TEXT))}, {only_if(f'{f}.digits > 3', lit(C.DIGITS_TEXT))}, "
        f"transform({f}.typos, b -> concat({lit(C.TYPO_TEXT)}, b, {lit(chr(39))})))")
    return (f"named_struct('domain', {f}.domain, 'risk_score', {score}, 'verdict', {verdict}, "
            f"'indicators', {indicators}, 'detected_brands', {f}.brands)")


@rule
def inspect_domain(domain: str) -> str:
    """The report of one domain, each stage bound once."""
    return let("p", _prep(domain), let("f", _flags("p"), _report("f")))


@rule
def inspect_links(links: str) -> str:
    """D13 without a shuffle: one report per link, in link order."""
    return (f"transform(transform(transform({links}, l -> {_prep('l.domain')}), p -> {_flags('p')}), "
            f"f -> {_report('f')})")


def high_risk_domains(reports: Column) -> Column:
    """D14."""
    return F.transform(F.filter(reports, lambda r: r["verdict"] == "High"),
                       lambda r: r["domain"])
