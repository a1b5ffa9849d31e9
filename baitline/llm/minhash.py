"""MinHash near-dedup by SuperMinHash signatures (operator 11).

A document's set: its distinct 5-word shingles (64-bit hashes); with fewer words the
whole sequence as one; without words or text it is empty and linked with nothing.
Documents link when their sets' Jaccard similarity is at least ``percent`` / 100.

Signature (SuperMinHash): every element walks a random permutation of the slots; the
slot it reaches at step j gets the smallest j + r, r uniform in [0, 1). A slot that
holds a value below j + 1 cannot change after step j, so a document stops at the first
step that leaves no slot above it: large sets after one step, small ones after few.
The steps run over many documents at once in numpy.

Search: equal sets are one. Signatures are cut into bands; sets that agree in a band
share a bucket. Within a bucket nothing is paired with everything:

1. each set is verified against two pivots of each of its buckets, the most central
   member and one other, on full sets;
2. verified links are joined by connected components;
3. sets of a bucket that still holds two components go through an exact prefix join
   (rarest shingles first, bounds by length and place), which pairs only sets of
   *different* components, and all its candidates are verified too.

So no pair of a bucket is left unanswered, and a group of near copies costs links, not
pairs. Sets are made again for the sets that share a bucket; no set is kept for the rest.

Recall: a pair at exactly 0.85 shares a bucket with probability 1 - (1 - 0.85**6)**24,
that is over 0.99998; links are confirmed on full sets, so none is wrong.

Null text: empty set. Rows that repeat a doc_id are rows of their own. A null doc_id
never names a component unless no other id is in it; a document alone is its own
component. An empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, splitmix, texts
from .components import connected_components

WORDS = 5
PERCENT = 85
BANDS, ROWS = 24, 6
SLOTS = BANDS * ROWS
#: Elements whose permutations are walked at a time (bounds memory, also for long texts).
_ELEMENTS = 1 << 16
_GOLD = 0x9E3779B97F4A7C15
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
_FRACTION = np.uint64(56)


def _odd(seed: int) -> np.uint64:
    return np.uint64((seed * _GOLD | 1) & 0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, words_per_shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles (ASCII letters lower-cased)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(words_per_shingle, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = splitmix(mixed * _odd(3) + hashes[k:k + n])
    return np.unique(mixed)


def _draws(elements: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(elements + _odd(2 * step + 5))


def _signatures(elements: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Signatures of ``n`` sets; element i belongs to set owner[i]."""
    least = np.full(n * slots, _UNSET)
    paths = None
    for step in range(slots):
        draw = _draws(elements, step)
        pick = ((draw >> np.uint64(40)) % np.uint64(slots - step)).astype(np.int64) + step
        if step == 0:
            slot = pick
        else:
            rows = np.arange(len(elements))
            slot = paths[rows, pick].astype(np.int64)
            paths[rows, pick] = paths[:, step]
        rank = (np.uint64(step) << _FRACTION) | (splitmix(draw) >> np.uint64(8))
        np.minimum.at(least, owner * slots + slot, rank)
        # sets with a slot that a later step can still lower
        open_sets = (least.reshape(n, slots) >= np.uint64(step + 1) << _FRACTION).any(axis=1)
        go_on = open_sets[owner]
        if not go_on.any():
            break
        if step == 0:
            paths = np.empty((int(go_on.sum()), slots), np.uint8)
            paths[:] = np.arange(slots, dtype=np.uint8)
            rows = np.arange(len(paths))
            paths[rows, pick[go_on]] = 0
            elements, owner = elements[go_on], owner[go_on]
        elif not go_on.all():
            elements, owner, paths = elements[go_on], owner[go_on], paths[go_on]
    return least.reshape(n, slots)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` ranks per set (all unset for an empty set)."""
    out = np.full((len(sets), slots), _UNSET)
    part: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal part, owners, held
        if part:
            owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
            found = _signatures(np.concatenate(part), owner, len(part), slots)
            for k, row in zip(owners, found):  # parts of a long set: the smallest of each slot
                np.minimum(out[k], row, out=out[k])
        part, owners, held = [], [], 0

    for k, elements in enumerate(sets):
        for i in range(0, len(elements), _ELEMENTS):
            piece = elements[i:i + _ELEMENTS]
            if held + len(piece) > _ELEMENTS:
                flush()
            part.append(piece)
            owners.append(k)
            held += len(piece)
    flush()
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket name for each band of each signature."""
    grid = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grid.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = splitmix(key * _odd(7) + grid[:, :, k])
    return key


def _set_name(elements: np.ndarray) -> int:
    """A 64-bit name of a set; 0 for the empty set."""
    return xxhash.xxh64_intdigest(elements.tobytes(), 1) if len(elements) else 0


def _signed(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: np.ndarray, lengths: list[int]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, row, name, n, keys): each row's set by name and size, and its buckets."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingle_set(x) for x in part["text"].to_pylist()]
                keys = band_keys(signatures(sets))
                full = np.array([len(x) > 0 for x in sets], bool)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["row"], _signed([_set_name(x) for x in sets]),
                     pa.array([len(x) for x in sets], pa.int64()),
                     _lists(keys[full].reshape(-1), [BANDS if x else 0 for x in full])],
                    ["doc_id", "row", "name", "n", "keys"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row_key().alias("row"), "text")
            .mapInArrow(rows, "doc_id bigint, row bigint, name bigint, n bigint, keys array<bigint>"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, n, elements) of the wanted rows (row, name), made from their texts again."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingle_set(x) for x in part["text"].to_pylist()]
                sizes = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [_signed([_set_name(x) for x in sets]), pa.array(sizes, pa.int64()),
                     _lists(np.concatenate([*sets, np.empty(0, np.uint64)]), sizes)], ["name", "n", "elements"])

    texts_of = (docs.select(_row_key().alias("row"), "text")
                .join(wanted.select("row"), "row", "left_semi").select("text"))
    return (texts_of.mapInArrow(rows, "name bigint, n bigint, elements array<bigint>")
            .dropDuplicates(["name"]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set names whose full sets are at least ``percent`` % alike."""
    left = sets.select(F.col("name").alias("a"), F.col("n").alias("a_n"), F.col("elements").alias("a_set"))
    right = sets.select(F.col("name").alias("b"), F.col("n").alias("b_n"), F.col("elements").alias("b_set"))
    common = F.size(F.array_intersect("a_set", "b_set")).cast("bigint")
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
            .withColumn("common", common)
            .where(100 * F.col("common") >= percent * (F.col("a_n") + F.col("b_n") - F.col("common")))
            .select("a", "b"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket (key, name, k: the bucket's size) with the bucket's two pivots.

    One is the most central member, the one that meets most others in all its buckets: in a
    group of edited copies that is a text near the original, which most copies are linked to.
    The other is any.
    """
    central = members.groupBy("name").agg(F.sum("k").alias("met"))
    ranked = members.select("key", "name").join(central, "name")
    pivots = (ranked.groupBy("key").agg(F.max(F.struct("met", "name"))["name"].alias("centre"),
                                        F.min(F.struct(F.xxhash64("name"), "name"))["name"].alias("other"))
              .select("key", F.explode(F.array_distinct(F.array("centre", "other"))).alias("pivot")))
    met = members.select("key", "name").join(pivots, "key").where("name <> pivot")
    return met.select(*_ordered(F.col("name"), F.col("pivot"))).distinct()


def _named(members: DataFrame, links: DataFrame) -> DataFrame:
    """(name, component) of every set that shares a bucket."""
    comps = connected_components(links)
    names = members.select("name").distinct()
    return (names.join(comps, names["name"] == comps["node"], "left")
            .select("name", F.coalesce("component", "name").alias("component")))


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of sets (name, component, n, elements) of different components that can
    be ``percent`` % alike: they share one of their rarest shingles, near enough to the front.

    Shingles are ordered by rarity, in one order for all. Two sets alike have at least
    ``need`` = ceil(percent (n + m) / (100 + percent)) shingles in common, so the first that
    they share has that many, itself included, from its place on in both. The smaller set of
    a pair is met by its first n - ceil(2 percent n / (100 + percent)) + 1 shingles, the larger
    by its first n - ceil(percent n / 100) + 1. Sets of the component that holds most of a
    shingle's sets are met by the others only, so a group that is linked already pairs
    with nothing inside.
    """
    tokens = sets.select("name", "component", "n", F.explode("elements").alias("token"))
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen"), F.min("component").alias("lo"),
                                       F.max("component").alias("hi"))
    order = Window.partitionBy("name").orderBy("seen", "token")
    whole = 100 + percent
    prefix = (tokens.join(seen, "token").withColumn("at", F.row_number().over(order))
              .where(F.expr(f"at <= n - (({percent} * n + 99) div 100) + 1 AND lo <> hi"))
              .withColumn("short", F.expr(f"at <= n - ((2 * {percent} * n + {whole - 1}) div {whole}) + 1")))
    prefix = materialise(prefix.select("token", "name", "component", "n", "at", "short"), "prefix")
    by_component = prefix.groupBy("token", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = (by_component.groupBy("token")
               .agg(F.max(F.struct("held", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("k"))
               .where("k > 1").select("token", "largest"))
    others = (prefix.join(largest, "token").where("component <> largest")
              .select("token", *[F.col(c).alias(f"x_{c}") for c in ("name", "component", "n", "at", "short")]))
    need = f"(({percent} * (n + x_n) + {whole - 1}) div {whole})"
    return (others.join(prefix, "token")
            .where(f"component <> x_component AND least(n - at, x_n - x_at) + 1 >= {need} "
                   f"AND 100 * least(n, x_n) >= {percent} * greatest(n, x_n) "
                   "AND CASE WHEN n < x_n THEN short WHEN x_n < n THEN x_short ELSE short AND x_short END")
            .select(*_ordered(F.col("x_name"), F.col("name"))).distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``."""
    rows = materialise(_described(docs), "minhash")
    one = F.min(F.struct("doc_id", "row"))
    distinct = materialise(rows.where("n > 0").groupBy("name").agg(
        one["row"].alias("row"), F.first("keys").alias("keys")), "minhash-sets")
    filed = distinct.select("name", F.explode("keys").alias("key"))
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = materialise(filed.join(shared, "key").select("key", "name", "k"), "minhash-members")
    wanted = materialise(distinct.join(members.select("name").distinct(), "name", "left_semi").select("row"),
                         "minhash-wanted")
    sets = materialise(_sets(docs, wanted), "minhash-full")

    links = materialise(_verified(_pivot_pairs(members), sets, percent), "minhash-links")
    comps = materialise(_named(members, links), "minhash-components")
    placed = members.select("key", "name").join(comps, "name")
    mixed = (placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("key"))
    open_sets = placed.join(mixed, "key", "left_semi").select("name", "component").distinct()
    more = _verified(_prefix_pairs(sets.join(open_sets, "name"), percent), sets, percent)
    comps = _named(members, links.unionAll(more))

    named = rows.join(comps, "name", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "name")).alias("component"))
    named = materialise(named, "minhash-named")
    first = (named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("first")))
    return (named.join(first, "component", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
