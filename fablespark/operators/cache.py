"""The clip cache as a table: lookup, validity, eviction, repair."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 0.75


def entry_is_valid(size: Column, measured: Column, recorded: Column, sha: Column, recorded_sha: Column) -> Column:
    """A file that exists with content, plays, and agrees with what was recorded."""
    good = (F.coalesce(size, F.lit(0)) > 0) & (F.coalesce(measured, F.lit(0.0)) > 0)
    length = (F.coalesce(recorded, F.lit(0.0)) <= 0) | (F.abs(measured - recorded) <= TOLERANCE)
    same = (F.coalesce(recorded_sha, F.lit("")) == "") | (sha == recorded_sha)
    return F.coalesce(good & length & same, F.lit(False))


def valid_entries(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file (filename, size, measured, sha) is valid."""
    f = files.select("filename", F.col("size").alias("__size"), F.col("measured").alias("__measured"), F.col("sha").alias("__sha"))
    return cache.join(f, "filename").filter(entry_is_valid(F.col("__size"), F.col("__measured"), F.col("duration"), F.col("__sha"), F.col("sha256"))).select(*cache.columns)


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after adding new ones: the latest of each key."""
    both = cache.unionByName(new, allowMissingColumns=True)
    return both.groupBy("cache_key").agg(F.max_by(F.struct(*both.columns), F.struct("created", "filename")).alias("e")).select("e.*")


def probe(segs: DataFrame, cache: DataFrame) -> DataFrame:
    """segs with status cached or pending, clip and duration by cache_key; of a repeated key the entry made last counts."""
    latest = F.struct(*(c for c in ("created", "last_accessed", "filename") if c in cache.columns))
    e = cache.groupBy(F.col("cache_key").alias("__k")).agg(F.max_by(F.struct("filename", "duration"), latest).alias("__e"))
    keep = [c for c in segs.columns if c not in ("status", "cache_file", "duration_seconds")]
    hit = F.when(F.col("__k").isNotNull(), "cached").otherwise("pending")
    return segs.select(*keep).join(e, F.col("cache_key") == F.col("__k"), "left").select(*keep, F.col("__e.filename").alias("cache_file"), F.col("__e.duration").alias("duration_seconds"), hit.alias("status"))


def pending(segs: DataFrame, stored: DataFrame) -> DataFrame:
    """Segments whose recomputed key has no stored clip: what remains to be synthesized."""
    return segs.join(stored.select("cache_key"), "cache_key", "left_anti")


def evict(cache: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The most recently used entries whose sizes sum to at most ``most``.

    With ``by``, each group has a budget of its own. Without, the edge is found by descent: sizes are summed by hour, then by time
    in the hour that holds the edge, then by the beginning of the key at that time, then by key. So neither a busy hour
    nor a table without times is ordered in one task, and the entries themselves are only compared with the
    edge, one row for each level, which is fetched as it is found. Entries without last_accessed are the oldest.
    """
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("last_accessed"), F.desc("cache_key")).rowsBetween(Window.unboundedPreceding, 0)
        return cache.withColumn("__sum", F.sum("size_bytes").over(order)).filter(F.col("__sum") <= most).drop("__sum")
    time = F.coalesce(F.col("last_accessed").cast("timestamp"), F.to_timestamp(F.lit("0001-01-01 00:00:00")))
    key = F.col("cache_key")
    head = lambda n: F.substring(key.cast("string"), 1, n)
    by_text = isinstance(cache.schema["cache_key"].dataType, T.StringType)
    micros = F.unix_micros(time)
    levels = [F.floor(micros / 3_600_000_000), micros, head(4) if by_text else F.floor(key / 2**16), key]
    at_edge, before, kept = F.lit(True), 0, []
    for level in levels:
        sums = cache.filter(at_edge).groupBy(level.alias("level")).agg(F.sum("size_bytes").alias("own"))
        upto = F.lit(before) + F.sum("own").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
        edge = sums.withColumn("upto", upto).filter(F.col("upto") > most).agg(F.max_by(F.struct("level", (F.col("upto") - F.col("own")).alias("before")), "level").alias("e")).first()["e"]
        if edge is None:  # all fits
            return cache
        kept.append(at_edge & (level > edge["level"]))
        at_edge, before = at_edge & (level == edge["level"]), edge["before"]
    return cache.filter(functools.reduce(operator.or_, kept))


def upsert(spark: SparkSession, path: str, new: DataFrame, parts: int = 64) -> None:
    """Put new entries into the cache table at ``path``: the latest of each key.

    The table is partitioned by a hash of the key; only the partitions that ``new`` touches are read and written again, the
    files of others stay as they are. The number of partitions is that of the table once it exists.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if there:
        old = spark.read.parquet(path)
        parts = int(old.select("parts").first()[0])
    place = F.pmod(F.xxhash64("cache_key"), F.lit(parts)).cast("int")
    new = new.withColumn("part", place)
    if there:
        touched = new.select("part").distinct()
        both = old.drop("parts").join(F.broadcast(touched), "part", "left_semi").unionByName(new, allowMissingColumns=True)
    else:
        both = new
    latest = both.groupBy("cache_key").agg(F.max_by(F.struct(*both.columns), F.struct("created", "filename")).alias("e")).select("e.*").withColumn("parts", F.lit(parts))
    latest.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a table that upsert() writes."""
    return spark.read.parquet(path).drop("part", "parts")


def repair(cache: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries that are valid, entries that were removed)."""
    good = valid_entries(cache, files)
    return good, cache.join(good.select("cache_key"), "cache_key", "left_anti")


def size_and_count(cache: DataFrame) -> DataFrame:
    return cache.agg((F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1048576).alias("size_mb"), F.count(F.lit(1)).alias("entries"))
