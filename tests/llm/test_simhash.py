import random

import pytest
import xxhash

from baitline.llm import simhash
from baitline.llm.components import connected_components
from baitline.llm.queries import simhash_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\r", " ")
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id)
                   for r in simhash.near_duplicates(df).collect()), key=str)


def test_against_brute_force(docs, corpus):
    want = brute_components(corpus)
    assert any(d != c for d, _, c in want)
    assert found(docs) == want


def test_links_of_chosen_fingerprints(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        x = v
        for _ in range(rng.randrange(4)):  # chains: each link is near, the ends are not
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint").repartition(5)
    pairs = simhash.links(df).collect()
    own = {simhash.signed(v): simhash.signed(v) for v in values}

    def top(v):
        while own[v] != v:
            v = own[v]
        return v

    for r in pairs:
        own[top(r.a)] = top(r.b)
    groups = lambda f, vs: sorted(sorted(x for x in vs if f(x) == k) for k in {f(x) for x in vs})
    got = [[x & (1 << 64) - 1 for x in g] for g in groups(top, list(own))]
    assert sorted(map(sorted, got)) == groups(root, values)


def test_a_large_shard_is_cut_into_blocks(spark, monkeypatch):
    """Fingerprints that share their first 40 bits: many blocks, the same components, bounded trees."""
    rng = random.Random(6)
    values = sorted({(0xABCDE12345 << 24) | rng.getrandbits(24) for _ in range(500)})
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint").repartition(4)

    def groups():
        comps = {r.node: r.component for r in connected_components(simhash.links(df)).collect()}
        out = {}
        for v in values:
            out.setdefault(comps.get(simhash.signed(v), simhash.signed(v)), []).append(v)
        return sorted(out.values())

    whole = groups()
    assert 1 < len(whole) < len(values)
    monkeypatch.setattr(simhash, "TREE", 40)
    assert groups() == whole
    sizes = [r["count"] for r in simhash.units(df).groupBy("shard", "x", "y").count().collect()]
    assert max(sizes) < 4 * 40 and len(sizes) > 50


def test_tree_follows_only_near_edges():
    tree, rng = simhash.BKTree(), random.Random(4)
    values = []
    for _ in range(400):
        v = rng.getrandbits(10)
        if v in values:
            continue
        near = tree.insert(v, 2)
        assert sorted(near) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]
        values.append(v)


def test_nulls_empty_and_clashes(spark, wide, corpus):
    rows = [(None, "a b c d"), (5, "a b c d"), (4, None), (None, ""), (None, "only null ids here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == brute_components(rows)
    assert found(df.limit(0)) == []
    kept = simhash.keep_first(wide)
    assert kept.columns == wide.columns
    want = {d for d, _, c in brute_components(corpus) if d == c}
    assert {r.doc_id for r in kept.collect()} == want
    with pytest.raises(ValueError):
        simhash.links(df, 4)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(40, 90), rng.randrange(40, 90)) for _ in range(30)]
    edges += [(95, 95), (None, 3), (0, 1), (1, 0)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    parent = list(range(100))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in range(100) if root(i) != i}
    assert connected_components(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in simhash_components(spark, sf).collect()), key=str)
    assert got == brute_components(rows)
