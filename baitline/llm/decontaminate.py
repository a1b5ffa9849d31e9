"""Benchmark decontamination (operator 10, DataFrame functions only).

A prefix-filtered containment join. An item's windows are ``window`` consecutive
words (an item of fewer words is one window). A window is a set of word
*shingles* (``shingle`` words, or the whole window when it is shorter):

1. Tokens: all shingles of all windows, as 64-bit hashes, and a bit array of
   fixed size (``FILTER_BITS``) with a bit for each. Documents test their
   shingles against the bit array inside generated code; only positions that
   pass leave the scan, with the few words around them.
2. Order by rarity: passing positions are counted per token. A contained window
   holds all its shingles, so its prefix is one token long: the rarest. Windows
   with a token that no document holds are dropped.
3. Join on the prefix token (salted: a passage may be in a third of all
   documents), apply the positional bound (the window starts at or after the
   document's start) and the length bound (it ends at or before its end), and
   verify word by word.

Only the bit array is broadcast; its size is a constant. Null text has no
words; an item without words has no window. Rows are told apart by doc_id and
text, so rows that repeat a doc_id with another text keep results of their own
and exact repeats get equal rows; null ids are ids like any other. An empty
table on either side gives no hits. Columns named like an output are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bits of the token filter; a constant, so its broadcast never grows.
FILTER_BITS = 1 << 22
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUTPUTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text: Column) -> Column:
    """``array<string>``: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _BREAKS), "")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(win, len, items): each distinct window with the items that hold it."""
    n = F.size("w")
    return (items.select("item_id", words(F.col("text")).alias("w")).where(n > 0)
            .select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).alias("i"))
            .select("item_id", F.slice("w", F.col("i"), window).alias("win"))
            .groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
            .withColumn("len", F.size("win")))


def _token(ws: Column, start: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(ws, start + k) for k in range(size)])


def _tokens(windows: DataFrame, shingle: int) -> DataFrame:
    """(win, off, size, token): the shingles of each window."""
    parts = []
    for size in range(1, shingle + 1):
        # windows of fewer words than a shingle are one shingle themselves
        of = windows.where(F.col("len") == size) if size < shingle else windows.where(F.col("len") >= size)
        parts.append(of.select("win", F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("off"))
                     .select("win", "off", F.lit(size).alias("size"),
                             _token(F.col("win"), F.col("off"), size).alias("token")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _slot(token: Column) -> Column:
    return F.pmod(token, F.lit(FILTER_BITS)).cast("int")


def _filter(tokens: DataFrame) -> Column:
    """A scalar subquery: the bit array, as FILTER_BITS / 64 longs."""
    spark = tokens.sparkSession
    set_bits = (tokens.select(_slot(F.col("token")).alias("s"))
                .groupBy(F.shiftright("s", 6).alias("id"))
                .agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("bits")))
    every = spark.range(FILTER_BITS >> 6).select(F.col("id").cast("int").alias("id"))
    return (every.join(set_bits, "id", "left")
            .agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint"))
                                                      .alias("bits")))).alias("a"))
            .select(F.col("a.bits").alias("a")).scalar())


def _passes(bits: Column, token: Column) -> Column:
    s = _slot(token)
    return F.getbit(F.get(bits, F.shiftright(s, 6)), s.bitwiseAND(F.lit(63))) == 1


def occurrences(docs: DataFrame, tokens: DataFrame, window: int) -> DataFrame:
    """Positions of ``docs`` (doc_id, text) whose shingle is a token, with the words around."""
    sizes = sorted(r[0] for r in tokens.select("size").distinct().collect())  # at most ``shingle`` numbers
    bits = _filter(tokens)
    spread = (docs.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))
              .select("doc_id", "row", "w", F.posexplode("w").alias("pos", "word")))
    out = None
    for size in sizes:
        token = _token(F.col("w"), F.col("pos"), size)
        low = F.greatest(F.col("pos") - (window - size), F.lit(0))
        part = (spread.where(F.col("pos") + size <= F.size("w")).where(_passes(bits, token))
                .select("doc_id", "row", "pos", F.size("w").alias("n"), token.alias("token"), low.alias("low"),
                        F.slice("w", low + 1, 2 * window).alias("around")))
        part = part.join(tokens.where(F.col("size") == size).select("token").distinct(), "token", "left_semi")
        out = part if out is None else out.unionAll(part)
    if out is None:  # no item has a word
        out = spread.where(F.lit(False)).select(
            F.lit(0).cast("bigint").alias("token"), "doc_id", "row", "pos", F.size("w").alias("n"),
            F.lit(0).alias("low"), F.col("w").alias("around"))
    return out


def hits(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """(doc_id, row, start, len, items): each place where a window occurs."""
    if not 0 < shingle <= window:
        raise ValueError("a shingle has at least one word and at most a window's")
    windows = materialise(_windows(items, window), "windows")
    tokens = materialise(_tokens(windows, shingle), "tokens")
    found = materialise(occurrences(docs, tokens, window), "occurrences")
    count = found.groupBy("token").agg(F.count(F.lit(1)).alias("n_found"))
    prefix = (tokens.join(count, "token", "left")
              .groupBy("win").agg(F.min(F.struct(F.coalesce("n_found", F.lit(0)).alias("n_found"), "off", "token"))
                                  .alias("p"))
              .where("p.n_found > 0").select("win", "p.off", "p.token").join(windows, "win")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "pos"), F.lit(SALTS)).cast("int"))
    start = F.col("pos") - F.col("off")
    return (salted.join(prefix, ["token", "salt"])
            .where((start >= 0) & (start + F.col("len") <= F.col("n")))
            .where(F.slice("around", start - F.col("low") + 1, F.col("len")) == F.col("win"))
            .select("doc_id", "row", start.alias("start"), "len", "items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5,
                  text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 (of the sorted item ids) and contaminated."""
    kept = [c for c in docs.columns if c.lower() not in OUTPUTS]
    source = docs.select("doc_id", F.col(text_col).alias("text"))
    per_doc = (hits(source, items, window, shingle).groupBy("doc_id", "row")
               .agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"),
                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
               .select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"),
                       F.aggregate("spans", F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n")),
                                   lambda a, x: F.struct(
                                       F.greatest(a["reach"], x["start"] + x["len"]).alias("reach"),
                                       (a["n"] + F.greatest(x["start"] + x["len"]
                                                            - F.greatest(x["start"], a["reach"]), F.lit(0))).alias("n")))
                       ["n"].cast("bigint").alias("__hit"), F.col("items").alias("__items")))
    left = docs.select(*kept, F.size(words(F.col(text_col))).cast("bigint").alias("__n"),
                       F.xxhash64(text_col).alias("__text"))
    joined = left.join(per_doc, left["doc_id"].eqNullSafe(per_doc["__id"]) & (left["__text"] == per_doc["__row"]),
                       "left")
    items_of = F.coalesce("__items", F.array().cast("array<string>"))
    return joined.select(*kept, F.col("__n").alias("n_words"), F.coalesce("__hit", F.lit(0).cast("bigint")).alias("n_hit"),
                         F.size(items_of).cast("bigint").alias("n_items"),
                         F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
                         (F.coalesce("__hit", F.lit(0)) > 0).alias("contaminated"))
