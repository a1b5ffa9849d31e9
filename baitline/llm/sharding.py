"""Sharding by a permutation-filled lookup table (operator 1, DataFrame and SQL functions only).

Every shard has a permutation of the ``slots`` (a prime number) of a table, from
two hashes of its name: ``(offset + j * skip) mod slots``. Shards take turns, each
claiming the first slot of its permutation that is still free, until all are
taken; so shares differ by one slot at most, and when a shard comes or goes few
slots change hands. The table is filled by a SQL fold over the turns, in one
row: its size is a parameter (at most ``MAX_SLOTS``), not data. It is broadcast,
and a row finds its shard in constant time: hash of its key, modulo slots.

Null keys hash as the empty text; rows with equal keys go to one shard and all
stay. An empty table gives an empty result. Other columns are kept; columns
named slot or shard are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 32, 4_099
MAX_SLOTS = 1 << 14
LOOK_AHEAD = 63


def key_hash(text: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table."""
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime number of at most {MAX_SLOTS}")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards need distinct names, at most one per slot")
    rows = spark.range(len(shards)).select(
        F.col("id"), F.get(F.array(*[F.lit(x) for x in shards]), F.col("id").cast("int")).alias("name"))
    # an aggregate, so that the fold reads the permutations and does not hash the names again
    one = rows.agg(F.sort_array(F.collect_list(F.struct(
        "id", "name", F.pmod(key_hash(F.concat("name", F.lit("#offset"))), F.lit(slots)).alias("offset"),
        (F.pmod(key_hash(F.concat("name", F.lit("#skip"))), F.lit(slots - 1)) + 1).alias("skip")))).alias("p"))
    # a shard looks for its next free place a few at a time, and then in all that is left
    free = (f"get(filter(sequence(t.next[who], {{last}}), "
            f"j -> t.owner[CAST((p[who].offset + j * p[who].skip) % {slots} AS INT)] < 0), 0)")
    near, rest = free.format(last=f"least(t.next[who] + {LOOK_AHEAD}L, {slots - 1}L)"), free.format(last=f"{slots - 1}L")
    filled = F.expr(f"""
        aggregate(
          sequence(0, {slots - 1}),
          struct(array_repeat(-1, {slots}) AS owner, array_repeat(0L, {len(shards)}) AS next),
          (table, turn) -> aggregate(
            array(turn % {len(shards)}),
            table,
            (t, who) -> transform(transform(
              array(coalesce({near}, {rest})),
              j -> struct(j, CAST((p[who].offset + j * p[who].skip) % {slots} AS INT) AS slot)),
              x -> struct(
                concat(slice(t.owner, 1, x.slot), array(who), slice(t.owner, x.slot + 2, {slots})) AS owner,
                concat(slice(t.next, 1, who), array(x.j + 1), slice(t.next, who + 2, {slots})) AS next))[0]),
          table -> table.owner)""")
    return (one.select(filled.alias("owner"), "p").select(F.posexplode("owner").alias("slot", "who"), "p")
            .select("slot", F.get("p", F.col("who"))["name"].alias("shard")))


def assign(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with slot and shard of the row's key."""
    table = lookup_table(df.sparkSession, shards, slots)  # at most MAX_SLOTS rows
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*kept, F.pmod(key_hash(F.col(key).cast("string")), F.lit(slots)).cast("int").alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """Write one folder per shard under ``path``."""
    assign(df, key, shards, slots).write.partitionBy("shard").mode("overwrite").parquet(path)
