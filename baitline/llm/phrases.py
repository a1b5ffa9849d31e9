"""Phrase collocation mining by top-order marginalisation (operator 12).

A text (ASCII letters lower-cased, null: empty) is cut into pieces at punctuation and
line ends, a piece into words at blanks. Lead-window columns put each word beside the
next three of its piece (null beyond the end): one row per word occurrence, and *only*
these longest, padded windows are counted. A ROLLUP over the four columns sums the
windows that share a prefix, which gives the frequency of every shorter phrase and,
at its top, the words of a language; no order of n-grams is exploded apart.

Windows are trimmed before they are counted, or a corpus of mostly rare word orders would
be shuffled several times over. A phrase of ``min_count`` occurrences consists of runs of
2 and of 3 words that each have as many, so a window may end before its first rarer run.
Runs are counted by 64-bit hash (pairs, then triples of frequent pairs), and the hashes
that reach ``min_count`` set bits of a *filter*, 64 bits for each and ``MAX_BITS`` at most,
that is broadcast in blocks of 32,768 bits. A false hit only trims less: frequencies are
exact for every corpus, and the filter's size has a bound whatever the corpus is.

Score of a phrase: over its cuts, the least of floor(scale * a / (l + r)); all arithmetic
is in integers and decimals. A phrase that lies inside a longer candidate with
``percent`` % of its occurrences or more is dropped.

Null lang counts as ``und``. Rows that repeat count as often as they occur; an empty
table gives an empty result; other columns are ignored. Ties go by phrase bytes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

ORDER = 4
MIN_COUNT = 30
SCALE = 2_000_000
PERCENT = 80
TOP = 2000
#: Bits of a filter at most (32 MB); beyond some 100 million frequent runs it trims little.
MAX_BITS = 1 << 28
#: Bits of a block: 512 longs.
_BLOCK = 1 << 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that end a piece, besides the line feed.
_ENDS = ".,;:!?\v\f\r"
_WORDS = [f"w{i}" for i in range(1, ORDER + 1)]


def windows(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, w1..): a row per word occurrence, with the words that follow it in its piece."""
    # one pass over the characters, then splits at single ones: no pattern is compiled per piece
    plain = F.translate(F.col("text"), _UPPER + _ENDS + "\t", _LOWER + "\n" * len(_ENDS) + " ")
    pieces = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                         F.explode(F.split(plain, "\n")).alias("piece"))
    words = pieces.select("lang", F.array_remove(F.split("piece", " "), "").alias("w")).where("size(w) > 0")
    leads = [F.col("w")] + [F.slice("w", k, F.size("w")) for k in range(2, order + 1)]
    zipped = F.arrays_zip(*[x.alias(n) for x, n in zip(leads, _WORDS)])
    return words.select("lang", F.inline(zipped)).toDF("lang", *_WORDS[:order])


def _run(first: int, size: int) -> Column:
    return F.xxhash64("lang", *_WORDS[first - 1:first - 1 + size])


class Filter:
    """The frequent ones of some 64-bit hashes (column h), as a broadcast table of bits."""

    def __init__(self, hashes: DataFrame, min_count: int) -> None:
        kept = materialise(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
                           .where(F.col("f") >= min_count).select("h"), "runs")
        wanted = max(64 * kept.count(), _BLOCK)
        self.bits = min(MAX_BITS, 1 << (wanted - 1).bit_length())
        at = kept.select(F.col("h").bitwiseAND(F.lit(self.bits - 1)).alias("at"))
        longs = at.groupBy(F.expr(f"cast(at div {_BLOCK} AS int)").alias("block"),
                           F.expr(f"cast(at % {_BLOCK} div 64 AS int)").alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("long"))
        self.blocks = materialise(
            longs.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "long"))).alias("held"))
            .select("block", F.transform(F.sequence(F.lit(0), F.lit(_BLOCK // 64 - 1)),
                                         lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("bigint"))).alias("longs")),
            "filter")

    def mark(self, rows: DataFrame, run: Column, name: str) -> DataFrame:
        """``rows`` with a boolean column: whether the run's bit is set (a null run: false)."""
        at, block = f"__at_{name}", f"__block_{name}"
        held = self.blocks.select(F.col("block").alias(block), F.col("longs").alias(f"__longs_{name}"))
        placed = rows.withColumn(at, run.bitwiseAND(F.lit(self.bits - 1)))
        met = placed.join(F.broadcast(held), F.expr(f"cast({at} div {_BLOCK} AS int)") == F.col(block), "left")
        bit = F.expr(f"coalesce(shiftright(__longs_{name}[cast({at} % {_BLOCK} div 64 AS int)], "
                     f"cast({at} % 64 AS int)) & 1L = 1L, false)")
        return met.select(*rows.columns, bit.alias(name))


def trimmed(docs: DataFrame, min_count: int) -> DataFrame:
    """The longest windows, ended before their first run of 2 or 3 words that is not frequent."""
    pairs = Filter(windows(docs, 2).where("w2 IS NOT NULL").select(_run(1, 2).alias("h")), min_count)
    three = windows(docs, 3).where("w3 IS NOT NULL")
    three = pairs.mark(pairs.mark(three, _run(1, 2), "a").where("a"), _run(2, 2), "b").where("b")
    triples = Filter(three.select(_run(1, 3).alias("h")), min_count)
    # a longer run is hashed and looked up only where the shorter one is frequent
    rows = pairs.mark(windows(docs), F.when(F.col("w2").isNotNull(), _run(1, 2)), "two")
    rows = triples.mark(rows, F.when(F.col("two") & F.col("w3").isNotNull(), _run(1, 3)), "three")
    rows = triples.mark(rows, F.when(F.col("three") & F.col("w4").isNotNull(), _run(2, 3)), "four")
    w2 = F.when(F.col("two"), F.col("w2"))
    w3 = F.when(w2.isNotNull() & F.col("three"), F.col("w3"))
    return rows.select("lang", "w1", w2.alias("w2"), w3.alias("w3"),
                       F.when(w3.isNotNull() & F.col("four"), F.col("w4")).alias("w4"))


def frequencies(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, w1..w4, size, f): the phrases of 0 to 4 words, later columns null; size 0 is
    the language. Complete for every phrase of ``min_count`` occurrences, and for all words."""
    top = trimmed(docs, min_count).groupBy("lang", *_WORDS).agg(F.count(F.lit(1)).alias("c"))
    # a null marks padding inside ROLLUP's own nulls: grouping bits tell the two apart
    rolled = (top.rollup("lang", *_WORDS)
              .agg(F.sum("c").alias("f"), F.grouping_id().alias("bits"),
                   *[F.grouping(w).alias(f"g{i}") for i, w in enumerate(_WORDS, 1)]))
    size = ORDER - sum((F.col(f"g{i}") for i in range(2, ORDER + 1)), F.col("g1"))
    padded = F.lit(False)
    for i, w in enumerate(_WORDS, 1):
        padded = padded | ((F.col(f"g{i}") == 0) & F.col(w).isNull())
    return (rolled.where("bits < 31").where(~padded)
            .select("lang", *_WORDS, size.cast("int").alias("size"), "f"))


def _phrase(first: int, last: int) -> Column:
    return F.concat_ws(" ", *[f"w{i}" for i in range(first, last + 1)])


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, scale: int = SCALE, percent: int = PERCENT,
            top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    counted = materialise(frequencies(docs, min_count).where((F.col("f") >= min_count) | (F.col("size") == 0)),
                          "phrases")
    known = counted.where("size > 0").select("lang", _phrase(1, ORDER).alias("part"), F.col("f").alias("part_f"))
    found = counted.where("size >= 2").select("lang", *_WORDS, "size", _phrase(1, ORDER).alias("phrase"),
                                              F.col("f").alias("a"))
    cuts = found.select("lang", "phrase", "a", F.explode(F.array(*[
        F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), _phrase(1, k).alias("head"),
                                           _phrase(k + 1, ORDER).alias("tail"))) for k in range(1, ORDER)])).alias("cut"))
    heads = known.select("lang", F.col("part").alias("head"), F.col("part_f").alias("l"))
    tails = known.select("lang", F.col("part").alias("tail"), F.col("part_f").alias("r"))
    wide = "decimal(20,0)"
    scored = (cuts.where("cut IS NOT NULL").select("lang", "phrase", "a", "cut.*")
              .join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
              .withColumn("score", F.expr(f"cast({scale} as {wide}) * cast(a as {wide}) "
                                          f"div (cast(l as {wide}) + cast(r as {wide}))"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
              .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    inner = (found.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(*[
        F.when(F.col("size") >= last, _phrase(first, last))
        for first in range(1, ORDER) for last in range(first + 1, ORDER + 1)])).alias("phrase"), F.col("phrase").alias("in"))
        .where("phrase IS NOT NULL AND phrase <> in").groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(f"longer IS NULL OR 100 * cast(longer as {wide}) < {percent} * cast(a as {wide})"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return (first.join(F.broadcast(totals), "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
