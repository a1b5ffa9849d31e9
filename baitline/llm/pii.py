"""Personal data (operator 7): fixed base patterns, widened by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always
stay. Further *candidates* are digit groups, mixed letter-digit tokens of any length
and letter-only values that follow a credential word and ``=`` or ``:``, where no
base span covers them. Seven labelers - patterns, gazetteers and context - vote on
every candidate: personal (1), not personal (0) or abstain (-1). Base spans pass by
definition and are not voted on, or their number would decide what is likely.
Votes over the whole corpus are counted per vote pattern (at most 3^7 of them,
so what reaches the driver is bounded by a constant), expectation-maximisation
estimates how reliable each labeler is and how likely each pattern is personal,
and a logistic regression is trained on span features with these likelihoods
as targets (again on counts of feature combinations). The classifier adds the
candidates it finds personal, as kind card, phone or secret.

All patterns run in linear time on any text: runs are matched possessively, and
the local part of an address is found backwards from its ``@``.

Null text is the empty text. Rows are independent; repeated rows get equal
spans. An empty table trains nothing and gives an empty result. Columns named
like an output are replaced.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .linear import sigmoid

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
OUTPUTS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_MIXED = re.compile(r"[0-9]+")
_ASSIGNED = re.compile(r"[A-Za-z_]++[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?([A-Za-z_-]{12,}+)")
_WORD_AT = re.compile(r"[A-Za-z_]+")
_WORD_BEFORE = re.compile(r"([A-Za-z_]+)[^A-Za-z_]{0,4}\Z")

# fixed values: gazetteers of the labelers
CREDENTIAL_WORDS = {"password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "bearer"}
CONTACT_WORDS = {"phone", "tel", "call", "mobile", "fax", "contact", "card", "visa", "mastercard", "account", "iban",
                 "mail", "email", "ssn", "ip", "host"}
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xox", "AIza")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> list[Span]:
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        lo = m.start()
        while lo > last and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
            lo -= 1
        if lo < m.start():
            out.append(("email", lo, m.end()))
            last = m.end()
    return out


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out = emails(text) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
            if m[1] is not None and all(map(_byte_sized, m[0].split(".")))]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            d = _only_digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                if 10 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _in_token(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "_-")


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Further spans to judge, none overlapping a base span or another candidate."""
    found: list[Span] = []
    last = 0
    for m in _MIXED.finditer(text):  # tokens of letters and digits, grown around their digits
        if m.start() < last:
            continue
        lo, hi = m.span()
        while lo > last and _in_token(text[lo - 1]):
            lo -= 1
        while hi < len(text) and _in_token(text[hi]):
            hi += 1
        last = hi
        while lo < hi and text[lo] == "-":  # a dash before a token is none of it
            lo += 1
        if hi - lo >= 12 and any(c.isalpha() for c in text[lo:hi]):
            found.append(("secret", lo, hi))
    if "=" in text or ":" in text:
        found += [("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)
                  if _WORD_AT.match(m[0])[0].lower() in CREDENTIAL_WORDS
                  and not (m.end() < len(text) and text[m.end()].isalnum())]
    found += [("phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    found += [("card", m.start(), m.end()) for m in _DIGITS.finditer(text)
              if m.end() - m.start() >= 13 and 13 <= len(_only_digits(m[0])) <= 19]
    out, reach = [], 0
    taken = sorted((s[1], s[2]) for s in base)
    k = 0
    for span in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        while k < len(taken) and taken[k][1] <= span[1]:
            k += 1
        if span[1] >= reach and not (k < len(taken) and taken[k][0] < span[2]):
            out.append(span)
            reach = span[2]
    return out


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote per labeler on a candidate: 1 personal, 0 not, -1 abstain."""
    kind, lo, hi = span
    s = text[lo:hi]
    digits = _only_digits(s)
    before = _WORD_BEFORE.search(text[max(0, lo - 24):lo])
    word = before[1].lower() if before else ""
    hexed = kind == "secret" and bool(re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", s))
    pattern = 1 if kind == "phone" or hexed or re.fullmatch(r"[A-Z0-9]{20}", s) else -1
    check = 0 if kind == "card" and not _is_card(digits) else -1
    prefix = 1 if s.startswith(KEY_PREFIXES) else -1
    context = 1 if word in (CREDENTIAL_WORDS if kind == "secret" else CONTACT_WORDS) else -1
    assigned = 1 if kind == "secret" and text[max(0, lo - 4):lo].rstrip(" \"'")[-1:] in ("=", ":") else -1
    spread = len(set(s)) / len(s)
    varied = 0 if spread < 0.25 and len(set(s)) < 8 else (1 if kind == "secret" and len(set(s)) >= 8 and digits else -1)
    alone = -1 if (lo == 0 or not text[lo - 1].isalnum()) and (hi == len(text) or not text[hi:hi + 1].isalnum()) else 0
    if len(set(digits)) == 1 and len(digits) > 3:
        varied = 0
    return pattern, check, prefix, context, assigned, varied, alone


def span_features(text: str, span: Span) -> tuple[int, ...]:
    """Small integers that describe a span: kind, length, digits, case, variety, what stands
    before, and whether its digits pass the card check."""
    kind, lo, hi = span
    s = text[lo:hi]
    share = sum("0" <= c <= "9" for c in s) / len(s)
    case = 2 * any(c.isupper() for c in s) + any(c.islower() for c in s)
    before = text[lo - 1] if lo else " "
    edge = 0 if before.isspace() else 1 if before in "=:\"'" else 2 if before.isalnum() else 3
    return (KINDS.index(kind), min(3, (hi - lo) // 8), min(3, int(4 * share)), case,
            min(3, len(set(s)) // 4), edge, int(_is_card(_only_digits(s))))


_SIZES = (5, 4, 4, 4, 4, 4, 2)
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])


def agree(patterns: np.ndarray, counts: np.ndarray, kinds: np.ndarray | None = None,
          rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (reliability of each labeler, likelihood of each pattern).

    Each kind has its own prior, so many spans of one kind do not speak for another; it is
    at most one half, so that a span needs a vote to be likelier personal than not.
    """
    kinds = np.zeros(len(patterns), int) if kinds is None else kinds
    on, yes = patterns >= 0, patterns == 1
    share = np.where(on, yes, 0.5).mean(axis=1)
    p = np.clip(share, 0.1, 0.9)
    right = np.full(patterns.shape[1], 0.8)
    for _ in range(rounds):
        w1, w0 = counts * p, counts * (1 - p)
        hit = ((w1[:, None] * (on & yes)).sum(0) + (w0[:, None] * (on & ~yes)).sum(0))
        right = np.clip((hit + 8) / (((w1 + w0)[:, None] * on).sum(0) + 10), 0.55, 0.99)  # prior: right 4 times in 5
        prior = np.clip((np.bincount(kinds, w1) + 1) / (np.bincount(kinds, counts) + 2), 0.05, 0.5)[kinds]
        weight = np.log(right / (1 - right))
        p = sigmoid(np.log(prior / (1 - prior)) + np.where(on, np.where(yes, weight, -weight), 0.0).sum(axis=1))
    return right, p


@dataclass
class Model:
    """Weights of the one-hot span features; empty weights add nothing."""
    weight: np.ndarray
    bias: float
    reliability: np.ndarray

    def personal(self, f: tuple[int, ...]) -> float:
        return float(sigmoid(self.bias + self.weight[_FIRST + np.array(f)].sum()))


def train(rows: list[tuple[tuple[int, ...], tuple[int, ...], int]]) -> Model:
    """Fit on (votes, features, count) rows."""
    if not rows:
        return Model(np.zeros(sum(_SIZES)), -10.0, np.zeros(0))
    v, counts = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float)
    right, p = agree(v, counts, np.array([r[1][0] for r in rows]))
    x = np.zeros((len(rows), sum(_SIZES)))
    for i, r in enumerate(rows):
        x[i, _FIRST + np.array(r[1])] = 1
    w, bias = np.zeros(x.shape[1]), 0.0
    n = np.sqrt(counts) / np.sqrt(counts).sum()  # damped, so that a frequent shape does not drown the rest
    for _ in range(600):
        e = n * (sigmoid(x @ w + bias) - p)
        w -= 2.0 * (x.T @ e + 1e-4 * w)
        bias -= 2.0 * e.sum()
    return Model(w, bias, right)


def observed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(votes, features, n): how often each combination occurs in the corpus."""
    @F.arrow_udf("array<struct<votes: string, features: string>>")
    def look(t: pa.Array) -> pa.Array:
        out = []
        for x in texts(t):
            out.append([{"votes": ",".join(map(str, votes(x, s))), "features": ",".join(map(str, span_features(x, s)))}
                        for s in candidates(x, base_spans(x))])
        return pa.array(out, pa.list_(pa.struct([("votes", pa.string()), ("features", pa.string())])))

    return (docs.select(F.explode(look(F.col(text_col))).alias("o")).groupBy("o.votes", "o.features")
            .agg(F.count(F.lit(1)).alias("n")))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Train on the votes over all of ``docs``."""
    rows = observed(docs, text_col).orderBy("votes", "features").collect()  # bounded: patterns, not spans
    ints = lambda s: tuple(map(int, s.split(",")))
    return train([(ints(r.votes), ints(r.features), r.n) for r in rows])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with counts and digest of the base spans, and the list of all spans."""
    @F.arrow_udf("struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, "
                 "base_sha256: string, spans: string>")
    def of(t: pa.Array) -> pa.Array:
        known: dict[tuple[int, ...], bool] = {}
        out = []
        for x in texts(t):
            base = base_spans(x)
            more = []
            for s in candidates(x, base):
                f = span_features(x, s)
                if f not in known:
                    known[f] = model.personal(f) >= 0.5
                if known[f]:
                    more.append(s)
            every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
            out.append((*[sum(s[0] == k for s in base) for k in BASE_KINDS],
                        hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        cols = zip(*out) if out else [[]] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], OUTPUTS)

    kept = [c for c in docs.columns if c.lower() not in OUTPUTS]
    return (docs.select(*kept, of(F.col(text_col)).alias("__found"))
            .select(*kept, *[F.col(f"__found.{c}").alias(c) for c in OUTPUTS]))
