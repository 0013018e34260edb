"""Mixing sources to target weights by fixed-length blocks and pseudorandom permutations.

The words of a source, in a fixed document order, are packed into blocks of ``block_words``.
Output shards draw how many of their slots each source gets from a multinomial law; a source's
slots, numbered across shards, run through one pseudorandom permutation of its block indices
after another, and slots meet blocks in a join on the index. No block is taken more than
``most`` times, so no document exceeds ``most`` times its size; slots that a source whose target is at
that limit draws beyond it stay empty, so such a source falls short by about half the draw's deviation.

Scale: documents shuffle once, without their text, for block offsets, which come from two
levels of sums so that a hot source spreads over buckets; slots and blocks are one narrow row
each. Only the list of sources (name, size, target), checked to be under ``MOST_SOURCES``,
reaches the driver. Draws are seeded by shard number, permutations by source, pass and seed,
so reruns agree.

Edge cases: a null text has size 0; documents of size 0 are never taken; a null source is a
source of its own, last in order; rows with one id are ordered by size and a hash of their text;
repeated rows have blocks of their own; extra columns with
any other name pass through pipeline_mixing(); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import staged
from ._text import Words, column_bytes, slices

WEIGHTS = (5.0, 2.0, 1.0)
MOST_SOURCES = 100_000
ROUNDS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in source order.

    Targets share the total by weight; a target stops at ``most`` times its size and the
    excess goes to the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    rest, free = float(sum(n for _, n in order)), dict(enumerate(weight))
    target = [0.0] * len(order)
    while free:
        share = rest / sum(free.values())
        full = [i for i, w in free.items() if share * w >= most * order[i][1]]
        if not full:
            for i, w in free.items():
                target[i] = share * w
            break
        for i in full:
            target[i] = most * order[i][1]
            rest -= target[i]
            del free[i]
    return [(s, n, t) for (s, n), t in zip(order, target, strict=True)]


def permuted(i: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed pseudorandom permutation of 0..n-1 (swap-or-not rounds), for any n."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, step)


def offsets(rows: DataFrame, group: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """rows with the running sum of ``size`` before each row, in a fixed order within a group.

    The order is by hash bucket, then by ``order``. There are as many buckets as rows in one, about,
    and totals of buckets are summed first, so neither a group's rows nor its buckets crowd one task.
    """
    n = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    base = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "__bucket").agg(F.sum(size).alias("__total")).withColumn("__base", F.coalesce(F.sum("__total").over(base), F.lit(0)))
    inner = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inner", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return rows.join(totals.drop("__total"), [*group, "__bucket"]).withColumn(out, F.col("__base") + F.col("__inner")).drop("__bucket", "__base", "__inner")


def draw_slots(spark: SparkSession, blocks: list[int], targets: list[float], sizes: list[int], shard_slots: int, seed: int, most: int) -> DataFrame:
    """(src, slot, block, shard): the slots of every source, with the block each one takes."""
    wanted = np.array([t / n * b if n else 0.0 for t, n, b in zip(targets, sizes, blocks, strict=True)])
    total = int(round(wanted.sum()))
    shards = -(-total // shard_slots)
    law = wanted / wanted.sum() if total else wanted
    schema = "shard long, src int, n long"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                size = min(shard_slots, total - int(shard) * shard_slots)
                n = np.random.Generator(np.random.PCG64([seed, int(shard)])).multinomial(size, law)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"shard": int(shard), "src": at.astype(np.int32), "n": n[at]})

    counts = spark.range(shards).mapInPandas(draw, schema).withColumn("some", F.expr("shard div 1000"))
    # slots before each shard, by two levels of sums, as a source may have all shards
    before = lambda order, *group: F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.groupBy("src", "some").agg(F.sum("n").alias("n")).select("src", "some", before("some", "src").alias("base"))
    first = counts.withColumn("inner", before("shard", "src", "some")).join(base, ["src", "some"]).withColumn("first", F.col("base") + F.col("inner"))
    # a shard's few counts become many slots, so shards are dealt out first
    first = first.repartition(max(8, -(-shards // 4)), "shard")
    slots = first.select("shard", "src", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    n_blocks = spark.createDataFrame(list(enumerate(blocks)), "src int, __n long")  # a row for each source, of which there are MOST_SOURCES at most
    slots = slots.join(F.broadcast(n_blocks), "src").filter(F.col("slot") < most * F.col("__n"))
    key = F.xxhash64(F.lit(seed), "src", F.floor(F.col("slot") / F.col("__n")))
    return slots.select("shard", "src", "slot", permuted(F.col("slot") % F.col("__n"), F.col("__n"), key).alias("block"))


def mix(sized: DataFrame, source: str = "source", size: str = "size", order: tuple[str, ...] = ("doc_id", "size", "tie"), weights: tuple[float, ...] = WEIGHTS, block_words: int = 64, shard_slots: int = 16_384, most: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan a mix of documents with known sizes.

    Returns (documents, pieces, slots): documents gain source_size, target, __src and __first
    (the offset of their first word in their source, 0 where they have none); ``order`` are columns that
    tell all different documents apart, which decides the result; pieces (__src, __first, from, to, times) say
    how often the mix takes the words [from, to) of a document.
    """
    spark = sized.sparkSession
    totals = sized.groupBy(source).agg(F.sum(size).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = source_targets([(r[0], r[1]) for r in totals], weights, float(most))
    lookup = spark.createDataFrame([(s, i, n, t) for i, (s, n, t) in enumerate(plan)], "__name string, __src int, source_size long, target double")
    docs = sized.join(F.broadcast(lookup), F.col(source).eqNullSafe(F.col("__name"))).drop("__name")
    some = offsets(docs.filter(F.col(size) > 0), ["__src"], list(order), size, "__first")
    docs = some.unionByName(docs.filter(F.col(size) == 0).withColumn("__first", F.lit(0).cast("long")))
    blocks = [-(-n // block_words) for _, n, _ in plan]
    slots = draw_slots(spark, blocks, [t for *_, t in plan], [n for _, n, _ in plan], shard_slots, seed, most)
    times = slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    last = F.col("__first") + F.col(size) - 1
    whole = some.select("__src", "__first", F.col(size).alias("__n"), F.explode(F.sequence(F.floor(F.col("__first") / block_words), F.floor(last / block_words))).alias("__block"))
    pieces = whole.join(times.hint("merge"), (F.col("__src") == F.col("src")) & (F.col("__block") == F.col("block"))).select(
        "__src", "__first",
        F.greatest(F.col("__block") * block_words - F.col("__first"), F.lit(0)).alias("from"),
        F.least((F.col("__block") + 1) * block_words - F.col("__first"), F.col("__n")).alias("to"), "times",
    )
    return docs, pieces, slots


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")
    planned, pieces, _ = mix(sized)
    taken = pieces.groupBy("__src", "__first").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("n"))
    out = planned.filter("size > 0").join(taken.hint("merge"), ["__src", "__first"], "left").unionByName(planned.filter("size = 0").withColumn("n", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"))


def pipeline_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes, as documents: one row for each pass over a document.

    A row keeps its document's columns; its text is the taken stretches of the original text,
    one to a line, and n_chars its length. A document that is taken three times gives three rows.
    """
    keep = docs.columns
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    sized = staged(carried.select("row", n_words(F.col("row.text")).alias("size"), F.col("row.source").cast("string").alias("source"), F.col("row.doc_id").alias("doc_id")).withColumn("tie", F.xxhash64(F.col("row.text"))), "mix-input")
    planned, pieces, _ = mix(sized.drop("row"))
    runs = pieces.groupBy("__src", "__first").agg(F.array_sort(F.collect_list(F.struct("from", "to", "times"))).alias("runs"))
    chosen = planned.filter("size > 0").join(runs.hint("merge"), ["__src", "__first"])
    # repeated rows share their key, so they are numbered on both sides
    numbered = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "size", "tie", "source").orderBy(F.lit(0))))
    both = ["doc_id", "size", "tie", "source", "nth"]
    left, right = numbered(sized), numbered(chosen.select("doc_id", "size", "tie", "source", "runs")).select(*(F.col(c).alias(f"r_{c}") for c in both), "runs")
    cond = None
    for c in both:
        same = F.col(c).eqNullSafe(F.col(f"r_{c}"))
        cond = same if cond is None else cond & same
    joined = left.join(right.hint("merge"), cond).select("row.*", F.col("runs").alias("__runs"))
    at = keep.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            texts, plans = batch.column(at), batch.column(len(keep)).to_pylist()
            rows, new = [], []
            for i, plan in enumerate(plans):
                buf, off = column_bytes(texts.slice(i, 1))
                words, raw = Words(buf, off), buf.tobytes()
                for k in range(1, 1 + max(p["times"] for p in plan)):
                    runs: list[list[int]] = []
                    for p in plan:
                        if p["times"] >= k:
                            if runs and runs[-1][1] == p["from"]:
                                runs[-1][1] = p["to"]
                            else:
                                runs.append([p["from"], p["to"]])
                    rows.append(i)
                    new.append(b"\n".join(raw[words.start[a] : words.end[b - 1]] for a, b in runs).decode())
            picked = batch.select(list(range(len(keep)))).take(pa.array(rows, pa.int64()))
            cols = list(picked.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in keep:
                k = keep.index("n_chars")
                cols[k] = pa.array([len(x) for x in new], pa.int64()).cast(batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, keep)

    return joined.mapInArrow(cut, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
