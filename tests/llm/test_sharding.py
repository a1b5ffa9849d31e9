import hashlib
from collections import Counter

import pytest

from baitline.llm import sharding


def brute(names, slots):
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    perm = [((h(s + "#offset")) % slots, h(s + "#skip") % (slots - 1) + 1) for s in names]
    owner, at = [None] * slots, [0] * len(names)
    for turn in range(slots):
        w = turn % len(names)
        o, k = perm[w]
        while owner[(o + at[w] * k) % slots] is not None:
            at[w] += 1
        owner[(o + at[w] * k) % slots] = names[w]
    return owner


@pytest.mark.parametrize("n,slots", [(1, 2), (3, 7), (5, 101), (7, 211)])
def test_table(spark, n, slots):
    names = [f"s{i}" for i in range(n)]
    got = {r.slot: r.shard for r in sharding.lookup_table(spark, names, slots).collect()}
    assert [got[i] for i in range(slots)] == brute(names, slots)
    shares = Counter(got.values()).values()
    assert max(shares) - min(shares) <= 1


def test_few_slots_move(spark):
    names = [f"s{i}" for i in range(8)]
    a, b = brute(names, 1009), brute(names[:-1], 1009)
    moved = sum(x != y for x, y in zip(a, b) if x != "s7")
    assert moved < 0.25 * 1009


def test_assign(spark, wide, corpus, tmp_path):
    names = ["a", "b", "c"]
    out = sharding.assign(wide, "doc_id", names, 101)
    assert set(out.columns) == set(wide.columns) | {"slot", "shard"}
    assert out.count() == len(corpus)
    table = brute(names, 101)
    for r in out.select("doc_id", "slot", out.shard.alias("to")).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.to) == (slot, table[slot])
    nulls = spark.createDataFrame([(None,), (None,), (1,), (1,)], "k bigint")
    assert sharding.assign(nulls, "k", names, 101).select("k", "shard").distinct().count() == 2
    assert sharding.assign(nulls.limit(0), "k", names, 101).count() == 0
    sharding.write_shards(nulls, "k", names, str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_parameters(spark):
    for names, slots in ((["a"], 8), (["a", "a"], 7), ([], 7), (["a"], 65_537)):
        with pytest.raises(ValueError):
            sharding.lookup_table(spark, names, slots)
