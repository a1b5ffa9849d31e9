"""Quality rules (operator 4): fixed base rules, then a calibrated n-gram classifier.

Base rules count words, their characters, symbols, repeated lines and words in
repeated 3-word windows; texts of under 50 words or with over half of their
words in repeated windows fail. The rest is decided by a logistic regression on
hashed n-grams: byte 3- to 5-grams within words (case and punctuation kept),
whole words, word pairs, and whether a word equals the one before. A text's
features are shares of its n-grams. Weights are fitted in numpy on a bounded
sample of labelled rows (``FIT_ROWS`` of each class, texts of at most
``FIT_CHARS`` characters); every fifth sampled row is kept out of the fit and
calibrates the probability (Platt). A text is kept when the probability of
quality 1 reaches ``THRESHOLD``; nothing else is learnt from the corpus.

Null text has no words: all counts 0, base_failed, not kept. Without labels of
both classes the base rules alone decide. Rows are independent. Columns named
like an output are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, texts
from .linear import byte_grams, platt, sample, sigmoid, word_hashes, word_spans

BUCKETS = 1 << 18
LOW, HIGH = 3, 5
FIT_ROWS, FIT_CHARS, EPOCHS = (1_500, 1_500), 10_000, 60
THRESHOLD = 0.4
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0  # all words differ
    window = codes[:n]
    for k in range(1, width):
        # ranks stay below the number of words, so the product fits 64 bits
        window = np.unique(window, return_inverse=True)[1] * np.int64(len(ids)) + codes[k:n + k]
    at, count = np.unique(window, return_inverse=True, return_counts=True)[1:]
    again = np.flatnonzero(count[at] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.split(None, 1):
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
            again, repeated_words(words))


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def features(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, one entry per occurrence."""
    words = text.encode().split()
    data = b" %b " % b" ".join(words)
    ids, valid = byte_grams(data, LOW, HIGH, BUCKETS)
    starts, ends = word_spans(data)
    h = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        pair = (h[1:] * np.uint64(0x9E3779B97F4A7C15)) ^ h[:-1]
    same = np.where(h[1:] == h[:-1], np.uint64(1), np.uint64(2))
    # the relation to the word before counts as often as the grams of a word, or shares would hide it
    whole = np.concatenate([h, pair, np.repeat(same, 4)]) % np.uint64(BUCKETS)
    return np.concatenate([ids[valid], whole.astype(np.int32)])


@dataclass
class Model:
    """Weight of each bucket, bias, and the calibration sigmoid(a z + b)."""
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, text: str) -> float:
        f = features(text)
        z = float(self.weight[f].mean(dtype=np.float64)) if len(f) else 0.0
        return float(sigmoid(self.a * (z + self.bias) + self.b))


def train(rows: list[tuple[int, str]]) -> Model | None:
    """Fit on (label, text) rows; None unless both classes are there."""
    # distinct buckets of each text with their counts
    rows = [(y, *np.unique(features(t), return_counts=True)) for y, t in rows]
    rows = [r for r in rows if len(r[1])]
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    rest = [r for k, r in enumerate(rows) if k % 5]
    if not all({0, 1} <= {r[0] for r in part} for part in (held, rest)):
        return None

    def matrix(part):
        """The buckets of all texts with their shares, as one long row."""
        return (np.concatenate([r[1] for r in part]),
                np.concatenate([(r[2] / r[2].sum()).astype(np.float32) for r in part]),
                np.array([len(r[1]) for r in part]))

    ids, share, sizes = matrix(rest)
    y = np.array([r[0] for r in rest])
    row = np.repeat(np.arange(len(rest)), sizes)
    heads = np.cumsum(sizes) - sizes
    w = np.zeros(BUCKETS, np.float64)
    bias = 0.0
    case = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    m, v, m0, v0 = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, EPOCHS + 1):  # Adam on the whole sample
        z = np.add.reduceat(w[ids] * share, heads) + bias
        e = (sigmoid(z) - y) * case
        g = np.bincount(ids, weights=e[row] * share, minlength=BUCKETS) + 1e-9 * w
        g0 = float(e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        m0, v0 = 0.9 * m0 + 0.1 * g0, 0.99 * v0 + 0.01 * g0 * g0
        c1, c2 = 1 - 0.9 ** step, 1 - 0.99 ** step
        w -= 1.0 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= 0.05 * (m0 / c1) / (np.sqrt(v0 / c2) + 1e-12)
    ids, share, sizes = matrix(held)
    z = np.add.reduceat(w[ids] * share, np.cumsum(sizes) - sizes) + bias
    a, b = platt(z, np.array([r[0] for r in held]))
    return Model(w.astype(np.float32), float(bias), a, b)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS,
        fit_chars: int = FIT_CHARS) -> Model | None:
    """Train on a bounded sample of labelled rows."""
    return train(sample(docs, labels, "quality", fit_rows, fit_chars))


def judge(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, quality (probability; null if base_failed) and kept."""
    @F.arrow_udf("struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, "
                 "n_repeat_words: bigint, base_failed: boolean, quality: double, kept: boolean>")
    def of(t: pa.Array) -> pa.Array:
        out = []
        for x in texts(t):
            counts = base_counts(x)
            failed = fails(counts[0], counts[4])
            p = None if failed or model is None else model.probability(x)
            out.append((*counts, failed, p, not failed and (p is None or p >= THRESHOLD)))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        cols = zip(*out) if out else [[]] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], OUTPUTS)

    kept = [c for c in docs.columns if c.lower() not in OUTPUTS]
    return (docs.select(*kept, of(F.col(text_col)).alias("__judged"))
            .select(*kept, *[F.col(f"__judged.{c}").alias(c) for c in OUTPUTS]))
