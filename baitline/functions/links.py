"""Link extraction rules.

A message's links are an ``array<struct<original, domain>>`` built with
``regexp_extract_all`` and higher-order functions, so finding links never
leaves the scan stage. ``parse_url`` is deliberately not used: it drops user
info (``http://user:pw@host`` must give ``user``) and raises on bad URLs
under ANSI mode.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .regex import ascii_first, js_re, python_re
from .rule import EMPTY, lit, rule

# Authority of an http(s) URL: everything after '//' up to '/', '?' or '#'.
_NETLOC = r"^https?://([^/?#]*)"
# A bracketed host is only accepted when balanced and IPv6-like.
_BRACKET_OK = r"^[^\[\]]*\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\][^\[\]]*$"


@rule
def find_urls(text: str) -> str:
    """L1: every URL match in order, duplicates kept; the pattern runs where one of its beginnings is."""
    begins = f"(contains({text}, '://') OR contains({text}, 'www.'))"
    return (f"CASE WHEN {begins} THEN regexp_extract_all({text}, {lit(ascii_first(python_re(C.URL_PATTERN)))}, 1) "
            f"WHEN {text} IS NOT NULL THEN {EMPTY} END")


def _netloc(url: str) -> str:
    return (f"regexp_extract(CASE WHEN startswith({url}, 'http') THEN {url} ELSE concat('http://', {url}) END, "
            f"{lit(_NETLOC)}, 1)")


def _netloc_ok(netloc: str) -> str:
    """L3: URLs whose authority has unbalanced or non-IPv6 brackets, or a character that
    normalises to a delimiter, are skipped."""
    return (f"(NOT (contains({netloc}, '[') OR contains({netloc}, ']')) OR {netloc} RLIKE {lit(_BRACKET_OK)}) "
            f"AND NOT {netloc} RLIKE {lit(f'(?=[^ -~])[{C.NFKC_DELIMITERS}]')}")


def _domain(netloc: str) -> str:
    """L2: lower-case, cut at the first ':', strip one leading 'www.'."""
    return f"regexp_replace(substring_index(lower({netloc}), ':', 1), '^www[.]', '')"


def _located(urls: str) -> str:
    return f"transform({urls}, u -> named_struct('original', u, 'netloc', {_netloc('u')}))"


@rule
def extract_links(text: str) -> str:
    """L1-L3: ``array<struct<original: string, domain: string>>`` in text order."""
    shaped = (f"transform(filter({_located(find_urls.sql(text))}, l -> {_netloc_ok('l.netloc')}), "
              f"l -> named_struct('original', l.original, 'domain', {_domain('l.netloc')}))")
    return f"filter({shaped}, l -> l.domain != '')"


def link_domains_text(links: str) -> str:
    """L5: 'a.com, b.net' as shown in the link step."""
    return f"array_join(transform({links}, l -> l.domain), ', ')"


def first_domain(links: Column) -> Column:
    """First link's domain or ''."""
    return F.coalesce(F.get(links, 0)["domain"], F.lit(""))


def lite_links(text: Column) -> Column:
    """Case-insensitive http(s) links up to whitespace or ')', host without
    user info, port and one leading 'www.'; searched for where a '://' is."""
    def host(u: Column) -> Column:
        authority = F.regexp_extract(u, r"^(?i)https?://([^/?#\\]*)", 1)
        no_user = F.regexp_replace(authority, r"^.*@", "")
        bare = F.regexp_replace(no_user, r":[0-9]*$", "")
        return F.regexp_replace(F.lower(bare), r"^www\.", "")
    urls = F.when(F.contains(text, F.lit("://")), F.regexp_extract_all(text, F.lit(js_re(C.LITE_URL_PATTERN)), 0)
                  ).when(text.isNotNull(), F.expr(EMPTY))
    return F.transform(
        urls,
        lambda u: F.struct(u.alias("original"), host(u).alias("domain")))
