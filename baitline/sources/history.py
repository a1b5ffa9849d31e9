"""The case-history store (S11, ST3): newest cases per user, in hash buckets of the user.

    root/data/v=<version>/bucket=<n>/*.parquet      rows of the buckets a merge has changed
    root/manifest/<version>.json                    which version holds each bucket

A merge touches the buckets of its users only: it reads their rows, puts the new cases
beside them, keeps the newest ``keep`` of each user and writes those buckets under a new
version. The manifest (one line per bucket at most) is published last, by a rename, so a
reader sees the store before or after a merge and never between. A merge that dies leaves
files that no manifest names; running it again overwrites them.

A case that comes again replaces its stored row. Buckets that no manifest of the last two
versions names are removed, so the folder stays about as large as the history.

One writer at a time (a stream's ``foreachBatch``, or a batch job): a second one fails
when it publishes a version that is taken.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as C
from .folders import Folder

BUCKETS = 64
#: Versions whose files stay readable: the current one and the one before.
KEPT_VERSIONS = 2


def newest_cases(cases: DataFrame, n: int = C.HISTORY_SIZE) -> DataFrame:
    """A5: the newest ``n`` rows of each user with their rank.

    The filter on the rank reaches the window, so Spark keeps at most ``n`` rows of a
    user per task before the shuffle: a hot user is no hot partition.
    """
    newest_first = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("msg_id").desc())
    return cases.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") <= n)


#: Bits of keys in all (16 MB) and in a row of their table; the bit of a key.
_BITS, _BLOCK = 2 ** 27, 4096
_BIT = f"pmod(xxhash64(_key), {_BITS})"


def key_bits(keys: DataFrame) -> DataFrame:
    """The set bits of keys, 64 longs a block: at most 32,768 rows, however many keys.

    With very many keys most bits are set and the filter lets most rows through; it loses none.
    """
    words = (keys.selectExpr(f"{_BIT} AS at")
             .groupBy(F.expr(f"at div {_BLOCK}").alias("_block"), F.expr(f"cast(at % {_BLOCK} div 64 AS int)").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("long")))
    held = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("word", "long"))).alias("held"))
    return held.select("_block", F.expr("transform(sequence(0, 63), w -> coalesce(held[w], 0L))").alias("_bits"))


class HistoryStore:
    """Rows of one schema with user_id, msg_id and ts. ``schema`` names the columns to keep;
    it is needed where nothing has been merged yet, and stays as first merged."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | None = None,
                 buckets: int = BUCKETS, keep: int = C.HISTORY_SIZE) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._folder = Folder(spark, self.root)
        self._schema, self._buckets = schema, buckets

    def manifest(self) -> dict:
        names = [n for n in self._folder.names("manifest") if n.endswith(".json") and not n.startswith(".")]
        if names:
            return json.loads(self._folder.read("manifest", names[-1]))
        return {"version": 0, "batch": None, "buckets": self._buckets, "at": {},
                "schema": self._schema.jsonValue() if self._schema is not None else None}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest()["buckets"])).cast("int")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """Stored rows of all buckets or of some, without their rank."""
        schema = StructType.fromJson(manifest["schema"])
        at = [(b, v) for b, v in manifest["at"].items() if buckets is None or int(b) in buckets]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(
            *[f"{self.root}/data/v={v}/bucket={b}" for b, v in at])

    def read(self, *users: int) -> DataFrame:
        """The stored cases, of all users or of those named (their buckets only)."""
        manifest = self.manifest()
        if not users:
            return self._rows(manifest)
        wanted = self.spark.createDataFrame([(u,) for u in users], "user_id bigint")
        buckets = {r[0] for r in wanted.select(self.bucket(F.col("user_id").cast(self._key_type(manifest)))).collect()}
        return self._rows(manifest, sorted(buckets)).where(F.col("user_id").isin(*users))

    @staticmethod
    def _key_type(manifest: dict):
        return StructType.fromJson(manifest["schema"])["user_id"].dataType

    def _candidates(self, cases: DataFrame, buckets: list[int], manifest: dict) -> DataFrame:
        """Stored rows of ``buckets`` and new ones, each with the (nullable) key that orders it."""
        columns = StructType.fromJson(manifest["schema"]).names
        rows = (self._rows(manifest, buckets).withColumn("_new", F.lit(0))
                .unionByName(cases.select(*columns).withColumn("_new", F.lit(1))))
        return rows.select(F.expr("struct(user_id, msg_id, _new, ts)").alias("_key"), F.struct(*columns).alias("row"))

    def kept_keys(self, rows: DataFrame) -> DataFrame:
        """The keys of the rows that stay: of a repeated case the one that came last, of a user the newest.

        Keys alone are read, by case first: the rows of a hot user are dealt by case, and thinned before they meet."""
        last = rows.groupBy("_key.user_id", "_key.msg_id").agg(F.max(F.struct("_key._new", "_key.ts")).alias("m"))
        return newest_cases(last.select("user_id", "msg_id", "m._new", "m.ts"), self.keep).select(
            F.struct("user_id", "msg_id", "_new", "ts").alias("_key"))

    def merged(self, cases: DataFrame, buckets: list[int], manifest: dict | None = None,
               kept: DataFrame | None = None) -> DataFrame:
        """The rows of ``buckets`` after the merge. ``kept``: their keys where they are stored already;
        then whole rows are shuffled only where the bit of their key is set."""
        rows = self._candidates(cases, buckets, manifest or self.manifest())
        keys = self.kept_keys(rows) if kept is None else kept
        if kept is not None:
            rows = (rows.withColumn("_at", F.expr(_BIT)).withColumn("_block", F.expr(f"_at div {_BLOCK}"))
                    .join(F.broadcast(key_bits(kept)), "_block")
                    .where(f"getbit(_bits[cast(_at % {_BLOCK} div 64 AS int)], cast(_at % 64 AS int)) = 1")
                    .select("_key", "row"))
        # structs with the same nulls are equal; rows of one key are grouped where they were joined
        return rows.join(keys, "_key").groupBy("_key").agg(F.max("row").alias("row")).select("row.*")

    def merge(self, cases: DataFrame, batch: int | None = None) -> None:
        """Merge cases; ``batch`` numbers the batches of a stream, and one that is merged is not merged again."""
        manifest = self.manifest()
        if manifest["schema"] is None:
            manifest["schema"] = cases.schema.jsonValue()
        if batch is not None and manifest["batch"] is not None and batch <= manifest["batch"]:
            return
        if batch is not None:  # a batch of a stream is computed once; stored cases are read column by column
            cases = cases.persist()
        try:
            touched = sorted(r[0] for r in cases.select(self.bucket(F.col("user_id")).alias("b")).distinct().collect())
            version = manifest["version"] + 1
            if touched:
                # the keys that stay are written first: they are read for the bits and for the match
                keys = f"{self.root}/keys/v={version}"
                self.kept_keys(self._candidates(cases, touched, manifest)).write.mode("overwrite").parquet(keys)
                # a bucket per task, large buckets split and small ones packed by adaptive execution
                (self.merged(cases, touched, manifest, self.spark.read.parquet(keys)).withColumn("bucket", self.bucket(F.col("user_id")))
                 .hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
                 .option("compression", "zstd").parquet(f"{self.root}/data/v={version}"))
            manifest |= {"version": version, "batch": manifest["batch"] if batch is None else batch,
                         "at": manifest["at"] | {str(b): version for b in touched}}
            self._folder.publish(json.dumps(manifest), "manifest", f"{version:012d}.json")
        finally:
            if batch is not None:
                cases.unpersist()
        self._folder.remove("keys")
        self.vacuum()

    def vacuum(self) -> None:
        """Remove manifests before the last two, and the buckets that only they named."""
        names = [n for n in self._folder.names("manifest") if n.endswith(".json") and not n.startswith(".")]
        live = {(str(v), str(b)) for n in names[-KEPT_VERSIONS:]
                for b, v in json.loads(self._folder.read("manifest", n))["at"].items()}
        for n in names[:-KEPT_VERSIONS]:
            self._folder.remove("manifest", n)
        newest = int(names[-1][:-5]) if names else 0
        for v in self._folder.names("data"):
            if int(v[2:]) > newest:  # a merge that has not been published
                continue
            buckets = [b for b in self._folder.names("data", v) if b.startswith("bucket=")]
            dead = [b for b in buckets if (v[2:], b[7:]) not in live]
            if len(dead) == len(buckets):
                self._folder.remove("data", v)
            else:
                for b in dead:
                    self._folder.remove("data", v, b)
