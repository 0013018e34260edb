"""Near duplicates of word-shingle sets by SetSketch registers.

A register is the truncated logarithm, to an exponential grid, of the least of exponentially
distributed hash values of a set: registers of a union are maxima, and similar sets agree in many.
Bands of registers propose pairs, the joint likelihood of greater, smaller and equal registers
estimates their similarity, and pairs that may pass are confirmed on the full sets.

Documents with equal sets form a class with one representative, so copies cost one row. A class is
found by its least id and the digest of its set, so different texts with one id are told apart, and
numbered when the classes are written out. In a
bucket, every representative is compared with the least one; components are formed from the
confirmed links; then only buckets that still hold several components are opened: their documents get
FINE more registers, and those that share a band of these and may pass by all of them make families of
components. A family's documents are compared on their full sets, block by block of similar sizes. A block
gives links that span its components, at most one for each document, so a family of documents that are all close
to the threshold, on either side of it, gives rows in proportion to its documents and none for its pairs.

Scale: texts are read in Arrow batches; what shuffles are bands (one narrow row each), registers
and sets of representatives that have a candidate. The ids of these are sent to the texts if they are few
(MOST_BROADCAST, counted), else texts are shuffled by id once for each use. Joins on hot
buckets or classes are plain equi-joins, which adaptive execution splits.

Edge cases: null and empty texts have an empty set, are linked with nothing and are kept; texts
of under five words have their whole word sequence as one shingle; rows with one id are one
node, which has the links of all its texts; an id may be any 64-bit number; null ids come after all others, and
rows with a null id are one node if their texts are equal; extra columns are ignored; an empty table gives no rows. The stage
judges different texts with one id apart, and keeps one row of those that are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import small_batches, staged
from ._text import Words, column_bytes, mix64, slices
from .components import components

BASE, RATE, TOP = 1.02, 20.0, 1500
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
SIGMAS = 5.0
FINE, FINE_ROWS = 1000, 10  # registers, of one byte, of documents in buckets with several components, and those of a band
MOST_BROADCAST = 1_000_000  # ids, of eight or sixteen bytes, that are sent to the texts; beyond, texts are shuffled to the ids
BLOCK = 1000  # documents of a bucket that one task holds, from each side
BLOCK_SHINGLES = 400_000  # shingles of a family that one task holds, from each side
_U = np.uint64


def shingle_sets(batch: pa.RecordBatch, k: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each text, lower-cased."""
    buf, off = column_bytes(batch.column(batch.schema.get_field_index(text)))
    words = Words(buf, off, lower=True)
    hashes = words.hashes()
    at, keys = words.windows(hashes, k)
    first = np.searchsorted(at, words.doc_off)
    sets = []
    for d in range(len(off) - 1):
        a, b = words.doc_off[d], words.doc_off[d + 1]
        if b - a >= k:
            sets.append(np.unique(keys[first[d] : first[d + 1]]))
        elif b > a:
            whole = _U(b - a)
            for h in hashes[a:b]:
                whole = mix64(np.array([whole ^ h]), 21)[0]
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def registers(hashes: np.ndarray, off: np.ndarray, m: int = REGISTERS, seed: int = 31) -> np.ndarray:
    """SetSketch registers (documents x m) of non-empty sets."""
    low = np.empty((m, len(off) - 1), np.uint32)
    mult = mix64(np.arange(m, dtype=np.uint64), seed) | _U(1)
    add = mix64(np.arange(m, dtype=np.uint64), seed + 1)
    with np.errstate(over="ignore"):
        for i in range(m):
            low[i] = np.minimum.reduceat(((hashes * mult[i] + add[i]) >> _U(32)).astype(np.uint32), off[:-1])
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP + 1).astype(np.uint16).T


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    bands = regs.shape[1] // rows
    with np.errstate(over="ignore"):
        keys = np.zeros((len(regs), bands), np.uint64)
        parts = regs.reshape(len(regs), bands, rows).astype(np.uint64)
        for j in range(rows):
            keys = mix64(keys ^ (parts[:, :, j] + _U(1)), j)
        return mix64(keys ^ np.arange(bands, dtype=np.uint64), 40)


def node(key: str, text: str) -> Column:
    """A document's node: (none, id), its id, or for a null id a hash of its text; null ids come after all others."""
    own = F.col(f"`{key}`").cast("long")
    return F.struct(own.isNull().alias("none"), F.coalesce(own, F.xxhash64(F.col(f"`{text}`"))).alias("id"))


NODE = "struct<none:boolean,id:long>"
SKETCH = f"id {NODE}, tie long, n long, s1 long, s2 long, bands array<long>, regs binary"


def sketches(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(id, tie, n, s1, s2, bands, regs): a hash of the text, set size, set digest, band keys and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                hashes, off = shingle_sets(part, k)
                n = np.diff(off)
                some = np.flatnonzero(n)
                one, two = digest(hashes, off, 0), digest(hashes, off, 1)
                bands = [None] * len(n)
                regs = [None] * len(n)
                if len(some):
                    r = registers(hashes, np.r_[off[some], off[-1]])
                    for i, b, x in zip(some, band_keys(r).view(np.int64).tolist(), r, strict=True):
                        bands[i], regs[i] = b, x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n), pa.array(one), pa.array(two), pa.array(bands, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                    ["id", "tie", "n", "s1", "s2", "bands", "regs"],
                )

    return _own(docs, key, text, F.xxhash64(F.col(f"`{text}`")).alias("tie")).mapInArrow(run, SKETCH)


def _own(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    return docs.select(node(key, text).alias("id"), F.col(f"`{text}`").alias("text"), *more)


def digest(hashes: np.ndarray, off: np.ndarray, which: int) -> np.ndarray:
    """A digest of each set; 0 for an empty one."""
    out = np.zeros(len(off) - 1, np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(mix64(hashes, 50 + which), off[some])
    return out.view(np.int64)


def joint_similarity(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of set pairs of known sizes, on a grid."""
    more, less = (one > two).sum(1), (one < two).sum(1)
    u, v = n_one / (n_one + n_two), n_two / (n_one + n_two)
    grid = np.linspace(0, 1, 201)
    top = np.minimum(u / v, v / u)
    prob = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)
    j = grid[None, :] * top[:, None]
    p_more, p_less = prob(u[:, None] - v[:, None] * j), prob(v[:, None] - u[:, None] * j)
    same = one.shape[1] - more - less
    law = more[:, None] * np.log(p_more) + less[:, None] * np.log(p_less) + same[:, None] * np.log(np.clip(1 - p_more - p_less, 1e-12, 1))
    return j[np.arange(len(j)), law.argmax(1)]


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate is within SIGMAS standard errors of the threshold, or above."""
    side = lambda c: reps.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    least = threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5)]
            sizes = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3)]
            yield batch.select(["a", "b"]).filter(pa.array(joint_similarity(*regs, *sizes) >= least))

    return joined.mapInArrow(run, "a long, b long")


def _to_texts(keys: DataFrame) -> DataFrame:
    """Keys of a staged table as the side of a join with texts: broadcast if they are counted to be few."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys.hint("merge")


def _with_sets(docs: DataFrame, names: DataFrame, k: int, key: str, text: str, out, columns: str) -> DataFrame:
    """(cls, columns) of classes by the sets of the texts that carry their id; ``out`` makes the columns from a batch's sets.

    names: cls, id, s1. A text of the same id with another set belongs to another class and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                hashes, off = shingle_sets(part, k)
                some = np.flatnonzero(np.diff(off))
                if len(some):
                    made = out(hashes, np.r_[off[some], off[-1]])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(digest(hashes, off, 0)[some]), *made.values()], ["id", "s1", *made])

    names = staged(names, "setsketch-names")
    own = _own(docs, key, text).join(_to_texts(names.select("id").distinct()), "id", "left_semi").select("id", "text")
    return own.mapInArrow(run, f"id {NODE}, s1 long, {columns}").dropDuplicates(["id", "s1"]).join(names.hint("merge"), ["id", "s1"]).drop("id", "s1")


def _items(hashes: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
    return {"items": pa.array([hashes[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())}


def _confirmed(pairs: DataFrame, docs: DataFrame, names: DataFrame, k: int, key: str, text: str, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets."""
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    # Staged, so that both sides of the joins come from plain exchanges: adaptive execution can then split a hub's links.
    full = staged(_with_sets(docs, names.join(ids, "cls"), k, key, text, _items, "items binary"), "setsketch-sets")
    side = lambda c: full.select(F.col("cls").alias(c), F.col("items").alias(f"items_{c}")).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def _mixed(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of groups that hold more than one component."""
    mixed = rows.groupBy(*by).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select(*by)
    return rows.join(mixed.hint("merge"), list(by), "left_semi")


def _equal_share(j: np.ndarray | float, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Expected share of equal registers of two sets with similarity j."""
    u, v = n_one / (n_one + n_two), n_two / (n_one + n_two)
    prob = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    return 1 - prob(u - v * j) - prob(v - u * j)


def _finer(rows: DataFrame, docs: DataFrame, names: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(cls, n, component, fine, keys): FINE registers, one byte each, and their band keys, of the documents of ``rows``."""

    def made(hashes: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
        fine = registers(hashes, off, FINE, 71).astype(np.uint8)
        return {"fine": pa.array([r.tobytes() for r in fine], pa.binary()), "keys": pa.array(list(band_keys(fine, FINE_ROWS).view(np.int64)), pa.list_(pa.int64()))}

    ids = rows.select("cls", "n", "component").distinct()
    return _with_sets(docs, names.join(ids.hint("merge"), "cls"), k, key, text, made, "fine binary, keys array<long>")


class _Union:
    """Components of a block's documents, which begin as those that are known."""

    def __init__(self, known: np.ndarray):
        self.label = np.unique(known, return_inverse=True)[1]

    def merge(self, i: int, j: int) -> bool:
        """Whether i and j were apart, as they are no longer."""
        a, b = self.label[i], self.label[j]
        self.label[self.label == b] = a
        return bool(a != b)


def _spread(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """Rows (bucket, band, cls, n, component, home) with size, own, lo, hi: every pair of blocks of a bucket's documents of like sizes.

    A document meets those of its own class of sizes (home) and of the next smaller one, as others differ too much in
    size. Where ``size`` adds up to more than ``most``, documents are cut into blocks, and each pair of blocks is a group.
    """
    by = ["bucket", "size"]
    rows = _mixed(rows.withColumn("size", F.explode(F.array("home", F.col("home") + 1))), *by)
    blocks = rows.groupBy(*by).agg(F.ceil(F.sum(size) / most).cast("int").alias("k"), F.max((F.col("home") == F.col("size")).cast("int")).alias("some")).filter("some = 1").drop("some")
    placed = rows.join(blocks.hint("merge"), by).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return placed.select(*by, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "band", "home", "cls", "n", "component")


def _columns(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]


def _partners(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, _Union]]:
    """(i, those that it is to be compared with, components) of a block pair; who is connected by then is left out."""
    n, comp, own, home = _columns(group, "n", "component", "own", "home")
    union, n = _Union(comp), n.astype(float)
    across = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
    here, every = home == group.column("size")[0].as_py(), np.arange(len(n))
    for i in np.flatnonzero(here):
        may = (union.label != union.label[i]) & ((every > i) | ~here) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if across:
            may &= own != own[i]
        if may.any():
            yield i, np.flatnonzero(may), union


def _families(fine: DataFrame, percent: int) -> DataFrame:
    """(component, family): components that documents in a common band of finer registers may connect, by all of their registers.

    A block gives links that span its families, not every pair, so that its rows follow its documents.
    """
    width = math.log(100 / percent) * (1 + 1e-9)
    rows = fine.select("cls", "n", "component", F.floor(F.log("n") / width).cast("int").alias("home"), F.posexplode("keys").alias("band", "bucket"))
    rows = staged(_mixed(rows, "bucket"), "setsketch-fine")
    spread = _spread(rows, F.lit(1), BLOCK).join(fine.select("cls", "fine").hint("merge"), "cls")

    def compare(group: pa.Table) -> pa.Table:
        n, comp = _columns(group, "n", "component")
        n = n.astype(float)
        regs = np.frombuffer(b"".join(group.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        one, two = [], []
        for i, at, union in _partners(group, percent):
            p = _equal_share(percent / 100, n[at], n[i])
            share = np.count_nonzero(regs[at] == regs[i], axis=1) / FINE
            for j in at[share >= p - SIGMAS * np.sqrt(p * (1 - p) / FINE)]:
                if union.merge(i, j):
                    one.append(comp[i])
                    two.append(comp[j])
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    links = spread.groupBy("bucket", "size", "lo", "hi").applyInArrow(compare, "a long, b long")
    return components(links).select(F.col("node").alias("component"), F.col("component").alias("family"))


def _family_links(fine: DataFrame, docs: DataFrame, names: DataFrame, k: int, key: str, text: str, percent: int) -> DataFrame:
    """Links (a, b) that span the components of every family, each confirmed on full sets where both are at hand."""
    width = math.log(100 / percent) * (1 + 1e-9)
    family = staged(_families(fine, percent), "setsketch-families")
    rows = fine.select("cls", "n", "component").join(family.hint("merge"), "component")
    rows = staged(rows.select("cls", "n", "component", F.floor(F.log("n") / width).cast("int").alias("home"), F.lit(0).alias("band"), F.col("family").alias("bucket")), "setsketch-members")
    full = staged(_with_sets(docs, names.join(rows.select("cls"), "cls", "left_semi"), k, key, text, _items, "items binary"), "setsketch-sets")
    spread = _spread(rows, F.col("n"), BLOCK_SHINGLES).join(full.hint("merge"), "cls")

    def confirm(group: pa.Table) -> pa.Table:
        (cls,) = _columns(group, "cls")
        buf, off = column_bytes(group.column("items"))
        off = off // 8
        shingle = np.unique(buf.view(np.uint64), return_inverse=True)[1]  # numbers within the block
        size, has = np.diff(off), np.zeros(int(shingle.max(initial=-1)) + 1, bool)
        one, two = [], []
        for i, at, union in _partners(group, percent):
            has[shingle[off[i] : off[i + 1]]] = True
            both = np.add.reduceat(has[shingle], off[:-1], dtype=np.int64)
            has[shingle[off[i] : off[i + 1]]] = False
            for j in at[100 * both[at] >= percent * (size[at] + size[i] - both[at])]:
                if union.merge(i, j):
                    one.append(cls[i])
                    two.append(cls[j])
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return spread.groupBy("bucket", "size", "lo", "hi").applyInArrow(confirm, "a long, b long")


def linked_classes(docs: DataFrame, percent: int, k: int, key: str, text: str, one_id: bool) -> tuple[DataFrame, DataFrame]:
    """(sketch of every row, component of every class of non-empty sets).

    With ``one_id``, the classes of an id's texts are linked, as an id is one node.
    """
    sketch = staged(sketches(docs, k, key, text), "setsketch")
    some = sketch.filter("n > 0")
    # numbered as they are written, so the numbers hold for all that reads them
    by_set = some.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("regs").alias("regs"))
    classes = staged(by_set.select(F.monotonically_increasing_id().alias("cls"), "id", "n", "s1", "s2", "bands", "regs"), "setsketch-classes")
    names = classes.select("cls", "id", "s1")
    rows = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    fits: Column = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    shared = rows.groupBy("bucket").agg(F.min(F.struct("cls", "n")).alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket", F.col("c.cls").alias("a"), F.col("c.n").alias("n_a"))
    member = rows.select("bucket", F.col("cls").alias("b"), F.col("n").alias("n_b"))
    first = staged(member.join(shared.hint("merge"), "bucket").filter("a <> b").filter(fits).select("a", "b").distinct(), "setsketch-pairs")

    def links(pairs: DataFrame) -> DataFrame:
        likely = staged(_estimated(pairs, classes, percent / 100), "setsketch-likely")
        return staged(_confirmed(likely, docs, names, k, key, text, percent), "setsketch-links")

    edges = links(first)
    if one_id:
        several = some.groupBy("id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).filter("lo <> hi").select("id")
        own = some.join(several, "id", "left_semi").select("id", "n", "s1", "s2").distinct().join(classes.select("n", "s1", "s2", "cls").hint("merge"), ["n", "s1", "s2"])
        least = own.groupBy("id").agg(F.min("cls").alias("b"))
        edges = edges.unionByName(own.select("id", F.col("cls").alias("a")).join(least.hint("merge"), "id").filter("a <> b").select("a", "b"))
    found = staged(components(edges), "setsketch-cc")
    label = rows.join(found.select(F.col("node").alias("cls"), "component").hint("merge"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    left = staged(_mixed(label, "bucket"), "setsketch-open")
    if not left.isEmpty():
        fine = staged(_finer(left, docs, names, k, key, text), "setsketch-finer")
        rest = staged(_family_links(fine, docs, names, k, key, text, percent), "setsketch-rest")
        if not rest.isEmpty():
            found = staged(components(edges.unionByName(rest)), "setsketch-cc")
    final = classes.select("n", "s1", "s2", "cls").join(found.select(F.col("node").alias("cls"), "component").hint("merge"), "cls", "left")
    return sketch, final.select("n", "s1", "s2", F.coalesce("component", "cls").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each document."""
    sketch, final = linked_classes(docs, percent, k, key, text, True)
    rows = staged(sketch.select("id", "n", "s1", "s2").filter("n > 0").join(final.hint("merge"), ["n", "s1", "s2"]).select("id", "n", "component"), "setsketch-rows")
    least = rows.groupBy("component").agg(F.min("id").alias("least"))
    out = rows.join(least.hint("merge"), "component").select("id", "n", F.col("least").alias("component"))
    out = out.unionByName(sketch.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    real = lambda c: F.when(~F.col(c)["none"], F.col(c)["id"])
    return out.select(real("id").alias("id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size, component and whether it stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def pipeline_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least id, then the least text hash.

    Rows of equal text and id are told apart by a hash of their other columns. Rows without words are all kept.
    """
    small_batches(spark)
    sketch, final = linked_classes(docs, 80, 5, "doc_id", "text", False)
    rows = sketch.filter("n > 0").select("id", "tie", "n", "s1", "s2").join(final.hint("merge"), ["n", "s1", "s2"]).select("component", F.struct("id", "tie").alias("row"))
    kept = rows.groupBy("component").agg(F.min("row").alias("kept"))
    by_row = rows.groupBy("row", "component").agg(F.count(F.lit(1)).alias("copies")).join(kept.hint("merge"), "component")
    judged = staged(by_row.filter("row <> kept or copies > 1").select(F.col("row.id").alias("id"), F.col("row.tie").alias("tie"), (F.col("row") == F.col("kept")).alias("stays")), "setsketch-judged")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), node("doc_id", "text").alias("id"), F.xxhash64("text").alias("tie"))
    alone = own.join(_to_texts(judged.select("id", "tie")), ["id", "tie"], "left_anti").select("doc.*")
    plain = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = own.join(_to_texts(judged.filter("stays").select("id", "tie")), ["id", "tie"], "left_semi").withColumn("order", F.xxhash64(*(F.col(f"doc.{c}") for c in plain)))
    return alone.unionByName(first.groupBy("id", "tie").agg(F.min_by("doc", "order").alias("doc")).select("doc.*"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower_az, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edge AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept
FROM w JOIN c ON c.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
