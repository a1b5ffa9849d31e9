"""The keyed case-history store."""
import os
import random

import pytest
from pyspark.sql import functions as F

from baitline.sources.folders import Folder
from baitline.sources.history import HistoryStore, newest_cases

SCHEMA = "user_id bigint, msg_id bigint, ts timestamp, verdict string"


def rows(spark, cases):
    return spark.createDataFrame([(u, m, t, v) for u, m, t, v in cases], "user_id bigint, msg_id bigint, t bigint, verdict string") \
        .select("user_id", "msg_id", F.timestamp_seconds("t").alias("ts"), "verdict")


def newest(cases, keep=8):
    """The last version of every case, then the newest of every user."""
    last = {}
    for u, m, t, v in cases:
        last[(u, m)] = (u, m, t, v)
    out = []
    for user in {u for u, *_ in last.values()}:
        mine = sorted((c for c in last.values() if c[0] == user), key=lambda c: (c[2], c[1]), reverse=True)
        out += mine[:keep]
    return sorted(out, key=str)


def stored(store, *users):
    return sorted(((r.user_id, r.msg_id, r.t, r.verdict) for r in store.read(*users).select(
        "user_id", "msg_id", F.unix_seconds("ts").alias("t"), "verdict").collect()), key=str)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "history")


def test_merges_equal_one_pass(spark, root):
    rng = random.Random(1)
    cases = [(rng.choice([1, 2, 3, 40, 500, None]), i, rng.randrange(1000), "High") for i in range(150)]
    cases += [(u, m, t, "Low") for u, m, t, _ in cases[:20]]                 # cases that come again
    store = HistoryStore(spark, root, buckets=4)
    for i in range(0, len(cases), 40):
        store.merge(rows(spark, cases[i:i + 40]))
        assert stored(store) == newest(cases[:i + 40])
    assert stored(store, 500) == [c for c in newest(cases) if c[0] == 500]
    assert stored(HistoryStore(spark, root)) == newest(cases)               # opened anew: buckets and schema stay


def test_an_upsert_reads_and_writes_its_bucket_only(spark, root):
    store = HistoryStore(spark, root, buckets=16)
    store.merge(rows(spark, [(u, u, 1, "High") for u in range(200)]))
    before = store.manifest()["at"]
    one = rows(spark, [(7, 1000, 2, "Low")])
    bucket = one.select(store.bucket(F.col("user_id"))).first()[0]
    read = {os.path.basename(os.path.dirname(f)) for f in store.merged(one, [bucket]).inputFiles()}
    assert read == {f"bucket={bucket}"}
    store.merge(one)
    after = store.manifest()["at"]
    assert [b for b in after if after[b] != before[b]] == [str(bucket)]
    assert Folder(spark, root).names("data", "v=2")[:1] == [f"bucket={bucket}"] or \
        f"bucket={bucket}" in Folder(spark, root).names("data", "v=2")
    assert stored(store, 7) == [(7, 1000, 2, "Low"), (7, 7, 1, "High")]


def test_a_replayed_batch_is_merged_once(spark, root):
    store = HistoryStore(spark, root)
    cases = [(1, i, i, "High") for i in range(12)]
    store.merge(rows(spark, cases[:6]), 0)
    store.merge(rows(spark, cases[6:]), 1)
    version = store.manifest()["version"]
    store.merge(rows(spark, cases[6:]), 1)
    assert store.manifest()["version"] == version
    assert stored(store) == newest(cases)


def test_a_merge_that_dies_leaves_the_store_as_it_was(spark, root, monkeypatch):
    store = HistoryStore(spark, root, buckets=2)
    store.merge(rows(spark, [(1, 1, 1, "High")]), 0)

    def fail(*_):
        raise OSError("lost")
    monkeypatch.setattr(Folder, "publish", fail)
    with pytest.raises(OSError):
        store.merge(rows(spark, [(1, 2, 2, "Low")]), 1)
    monkeypatch.undo()
    assert stored(store) == [(1, 1, 1, "High")]
    store.merge(rows(spark, [(1, 2, 2, "Low")]), 1)
    assert stored(store) == [(1, 1, 1, "High"), (1, 2, 2, "Low")]


def test_superseded_buckets_are_removed(spark, root):
    store = HistoryStore(spark, root, buckets=2)
    for i in range(6):
        store.merge(rows(spark, [(1, i, i, "High"), (2, 100 + i, i, "High")]))
    folder = Folder(spark, root)
    assert len(folder.names("manifest")) == 2
    assert folder.names("data") == ["v=5", "v=6"]
    assert stored(store) == newest([(1, i, i, "High") for i in range(6)] + [(2, 100 + i, i, "High") for i in range(6)])


def test_a_second_writer_fails(spark, root):
    store = HistoryStore(spark, root)
    store.merge(rows(spark, [(1, 1, 1, "High")]))
    store._folder.publish("{}", "manifest", f"{2:012d}.json")
    store._folder.remove("manifest", f"{2:012d}.json")
    Folder(spark, root).publish(open(f"{root}/manifest/{1:012d}.json").read(), "manifest", f"{2:012d}.json")
    with pytest.raises(FileExistsError):
        store._folder.publish("{}", "manifest", f"{2:012d}.json")


def test_empty_loads_and_an_empty_store(spark, root):
    empty = spark.createDataFrame([], SCHEMA)
    assert HistoryStore(spark, root, empty.schema).read().count() == 0
    store = HistoryStore(spark, root)
    store.merge(empty)
    assert store.read().count() == 0
    store.merge(rows(spark, [(1, 1, 1, "High")]))
    assert stored(store) == [(1, 1, 1, "High")]


def test_a_hot_user_is_thinned_before_the_shuffle(spark, root):
    store = HistoryStore(spark, root)
    one = rows(spark, [(1, 1, 1, "High")])
    store.merge(one)
    plan = store.merged(one, [0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_nested_reports_are_read_by_field(spark, tmp_path):
    """A4: a reader of one report field reads that column only."""
    path = str(tmp_path / "cases")
    spark.range(3).select(
        F.col("id").alias("user_id"), F.struct(F.lit("a").alias("redacted_text"), F.lit("b").alias("report_draft"))
        .alias("report")).write.parquet(path)
    plan = spark.read.parquet(path).select("report.redacted_text")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<report:struct<redacted_text:string>>" in plan


def test_a_merge_decides_on_keys_alone(spark, root):
    """Repeated cases, ties and null keys: as if whole rows were grouped; whole rows go through a filter on their key's bit."""
    rng = random.Random(5)
    cases = [(rng.choice([1, 2, None]), rng.randrange(60), rng.choice([None, *range(50)]), f"{i}") for i in range(400)]
    store = HistoryStore(spark, root, buckets=2)
    store.merge(rows(spark, cases[:200]))
    rows(spark, cases[200:]).write.parquet(f"{root}-new")
    old, new = store.read(), spark.read.parquet(f"{root}-new")
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = both.groupBy("user_id", "msg_id").agg(F.max(F.struct("_new", "ts", F.struct(*old.columns).alias("row"))).alias("m"))
    want = sorted(map(str, newest_cases(last.select("m.row.*")).drop("rank").collect()))
    keys = store.kept_keys(store._candidates(new, [0, 1], store.manifest()))
    assert "verdict" not in keys._jdf.queryExecution().executedPlan().toString()     # keys alone are read
    keys.write.parquet(f"{root}-keys")
    merged = store.merged(new, [0, 1], None, spark.read.parquet(f"{root}-keys"))
    assert "getbit" in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, merged.collect())) == sorted(map(str, store.merged(new, [0, 1]).collect())) == want
    store.merge(new)
    assert sorted(map(str, store.read().collect())) == want and "keys" not in os.listdir(root)
