"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, from two hashes of its
name. Shards take turns, each claiming the first free slot it prefers, until the table is full;
so slots are spread evenly, and adding or removing a shard moves few of them. A row's key hash
picks a slot, and the table, broadcast, gives its shard in constant time.

Scale: the main path is DataFrame functions only, with one broadcast join and no shuffle. The
table's size is a parameter (at most ``MOST_SLOTS``), not a function of the data. Keys are
hashed, so a hot source or bucket spreads over all shards.

Edge cases: a null key counts as the empty string; repeated keys share a shard; extra columns
pass through, whatever their names; with_shard() refuses an output name that exists, and the
stage takes the next free one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import free, refuse

SLOTS = 65_537
MOST_SLOTS = 1_048_583


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that holds each slot."""
    if not 1 <= len(shards) <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    number = lambda name, use: int.from_bytes(hashlib.md5(f"{use}:{name}".encode()).digest()[:8], "big")
    at = [number(s, "offset") % slots for s in shards]
    step = [number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, filled = [-1] * slots, 0
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            filled += 1
            if filled == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the table size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % F.lit(slots)


def _table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    filled = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def with_shard(df: DataFrame, key: str = "doc_id", shards: int | list[str] = 256, slots: int = SLOTS, out: str = "shard") -> DataFrame:
    """df with the shard index of each row as ``out`` (int)."""
    refuse(df, out)
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    slot, own = free(df, "__slot"), free(df, "__key_slot")
    table = F.broadcast(_table(df.sparkSession, names, slots).select(F.col("slot").alias(slot), F.col("shard").alias(out)))
    placed = df.withColumn(own, slot_of(F.col(f"`{key}`"), slots))
    return placed.join(table, F.col(own) == F.col(slot), "left").select(*(F.col(f"`{c}`") for c in df.columns), F.col(f"`{out}`"))


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Write one folder for each shard."""
    df.write.partitionBy(shard).parquet(path)


def pipeline_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that holds each, as the first free name of shard, shard_, ..."""
    return with_shard(docs, out=free(docs, "shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size in bytes, slot and shard, over 256 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), slot_of(F.col("doc_id")).alias("slot"))
    return with_shard(slim)


def op10_sql() -> str:
    table = ",".join(map(str, lookup_table([f"shard-{i:05d}" for i in range(256)])))
    return f"""
WITH lookup AS (SELECT unnest(range({SLOTS})) AS slot, unnest(string_split('{table}', ',')) AS shard),
placed AS (
  SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS BIGINT) AS slot
  FROM documents)
SELECT doc_id, n_bytes, slot, CAST(shard AS INTEGER) AS shard FROM placed JOIN lookup USING (slot)"""
