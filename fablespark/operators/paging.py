"""Pages deep in an ordered table, found by descent instead of a global sort.

A page's first row is the one of a known rank. Splitters drawn from the rows cut the key range into
cells; one aggregation counts the rows of each cell, and the cell that holds the rank is cut again
until it is small. Only then are rows sorted: those of the small cell and the page itself, as a top-k.
The splitters decide how many passes it takes, never which rows come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITTERS, SMALL = 48, 50_000
_NO_HASH = (T.MapType, T.VariantType)


def _keyed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[T.DataType]]:
    """rows with ``__key``: the order's columns, then a hash of all others, so that equal keys are equal rows."""
    rest = [f.name for f in rows.schema.fields if f.name not in order and not isinstance(f.dataType, _NO_HASH)]
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(0).cast("long")
    types = [rows.schema[c].dataType for c in order] + [T.LongType()]
    return rows.withColumn("__key", F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)), tie.alias("tie"))), types


def _literal(key, types: list[T.DataType]) -> Column:
    names = [*(f"k{i}" for i in range(len(types) - 1)), "tie"]
    return F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(key, types, names, strict=True)))


def page_at(rows: DataFrame, order: list[str], offset: int, size: int, small: int = SMALL, splitters: int = SPLITTERS, seed: int = 11) -> DataFrame:
    """The rows of rank ``offset`` to ``offset + size - 1`` by the columns ``order``, nulls first, in that order.

    Rows that are equal in ``order`` follow a hash of their other columns (maps left out), so pages do not
    overlap or lose rows. An offset past the end gives no rows; an empty table gives none.
    In each pass the keys of at most ``splitters`` rows and the counts of at most ``2 * splitters + 1`` cells come to the driver.
    """
    keyed, types = _keyed(rows, order)
    key, inside, skip = F.col("__key"), keyed, offset
    first: Column | None = None
    left = keyed.count()
    while left > small:
        cuts = inside.select("__key").orderBy(F.rand(seed)).limit(splitters).distinct().orderBy("__key").collect()
        ends = F.array(*(_literal(c["__key"], types) for c in cuts))
        # cells 0, 2, 4 ... lie between splitters, cells 1, 3, 5 ... hold the rows equal to one
        cell = 2 * F.size(F.filter(ends, lambda e: e < key)) + F.array_contains(ends, key).cast("int")
        counts = {r["cell"]: r["n"] for r in inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = next((c for c in sorted(counts) if (skip := skip - counts[c]) < 0), None)
        if at is None:
            return rows.limit(0)
        skip += counts[at]
        low = _literal(cuts[(at - 1) // 2]["__key"], types) if at else None
        if at % 2:
            return _equal_then_later(keyed, low, skip, size, counts[at], rows.columns)
        if low is not None:
            inside, first = inside.filter(key > low), key > low
        if at // 2 < len(cuts):
            inside = inside.filter(key < _literal(cuts[at // 2]["__key"], types))
        left = counts[at]
    tail = keyed if first is None else keyed.filter(first)
    return tail.orderBy("__key").offset(skip).limit(size).select(*(F.col(f"`{c}`") for c in rows.columns))


def _equal_then_later(keyed: DataFrame, low: Column, skip: int, size: int, equal: int, columns: list[str]) -> DataFrame:
    """A page that begins among ``equal`` equal rows: as many of them as it takes, then those that follow."""
    key, take = F.col("__key"), min(size, equal - skip)
    same = keyed.filter(key == low).limit(take)
    more = keyed.filter(key > low).orderBy("__key").limit(size - take)
    return same.unionByName(more).orderBy("__key").select(*(F.col(f"`{c}`") for c in columns))


def page(rows: DataFrame, order: list[str], number: int, size: int = 12, **descent: int) -> DataFrame:
    """Page ``number`` from 0, clamped to the pages there are."""
    last = max(1, -(-rows.count() // size)) - 1
    return page_at(rows, order, max(0, min(number, last)) * size, size, **descent)
