import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from baitline.llm import line_dedup
from baitline.llm.queries import line_dedup_digests

WHITE = " \t\n\r\x0b\x0c"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-(1 << 63) if d is None else d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == (-(1 << 63) if d is None else d) or key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    from pyspark.sql import functions as F
    got = line_dedup.drop_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("s"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_against_brute_force(docs, corpus):
    want = brute(corpus)
    assert any(n for _, _, n, _ in want)
    assert digests(docs) == want


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_broadcast_and_shuffled_shards_agree(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    assert digests(docs) == brute(corpus)


def test_one_shard_is_probed_by_several_tasks(spark, docs, corpus, monkeypatch):
    """Parts of a shard's probes: the same lines go, and the largest task holds a part of them."""
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 1)
    monkeypatch.setattr(line_dedup, "PART_PROBES", 8)
    assert digests(docs) == brute(corpus)
    lines = spark.range(4000).selectExpr("id AS doc_id", "id % 50 AS h1", "id % 50 AS h2")
    keys = line_dedup.repeated_keys(lines, 3)
    hits = line_dedup.probe_shards(lines, line_dedup.shard_arrays(keys, 1), 1, 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these parts are small
    try:
        tasks = hits.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in tasks) == 4000 - 50 and len(tasks) > 1


def test_null_ids_ties_and_clashes(spark, wide, corpus):
    rows = [(None, "the same line of thirty chars!!")] * 2 + [(7, "the same line of thirty chars!!")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digests(df) == brute(rows)
    out = line_dedup.drop_lines(wide)
    assert set(out.columns) == set(wide.columns) | {"n_lines", "n_dropped"}
    assert out.count() == len(corpus)
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(-(1 << 63), (1 << 63) - 1, 5000) for _ in range(2))
    h1[:50] = h1[0]  # equal halves are told apart by the other half
    made = line_dedup.Shard.of(h1, h2, np.arange(5000), np.arange(5000) * 2)
    shard = line_dedup.Shard.load(*made.dump())
    at = shard.probe(h1, h2)
    assert sorted(at) == list(range(5000))
    assert (shard.counts[at] == np.arange(5000)).all() and (shard.keepers[at] == np.arange(5000) * 2).all()
    assert (shard.probe(h1 + 1, h2 + 1) == -1).all()
    empty = line_dedup.Shard.of(*[np.zeros(0, np.int64)] * 4)
    assert line_dedup.Shard.load(*empty.dump()).probe(h1[:3], h2[:3]).tolist() == [-1] * 3


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in line_dedup_digests(spark, sf).collect()), key=str)
    assert got == brute(rows)
