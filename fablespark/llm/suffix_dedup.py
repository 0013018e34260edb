"""Suffix-array dedup by deep-shallow sorting.

Every byte covered by a ``width``-byte string that also starts in a document with a smaller id
is removed. Suffixes that can have a partner are found first: the smallest hashed gram of each
window (its minimiser) is equal in equal windows, so only windows whose minimiser also occurs in
another document stay. Their stretches of text go to the bucket of the minimiser, which sorts all
suffixes that start a window: multikey quicksort on eight-byte characters (partition by a pivot into
less, equal and greater, equal ones going on to the next character) down to a shallow depth, then
a blind trie for each group that still agrees. Neighbours that agree on ``width``
bytes give the smallest id of each string.

Scale: text shuffles once, to chunks; three steps use that exchange. Minimiser hashes (about one
for 16 bytes) and stretches travel packed, once for each chunk, and equal stretches are sorted
once, so exact copies cost one row each and no pairs are formed. A gram that more than half of the
chunks share, as in a licence line with different text around it, does not fill one bucket: its
windows travel one by one, to the bucket of their own bytes; rarer grams have less than one
stretch a chunk on average. Every comparison that decides is on the bytes themselves.

Edge cases: null and empty texts lose nothing; texts shorter than ``width`` lose nothing; rows
with the same id never remove each other; a null id counts as the largest; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._packed import MESSAGE, Plan, bit_pieces, bucket_of, chunked, in_order, load_chunk, messages, no_messages, pieces, plan_for, read_bits, split
from ._text import column_bytes, cover, mix64
from .substring_cover import ask_keys, counted_keys

GRAM = 20
SHALLOW = 24
SHORT = 32  # suffixes of a segment that is sorted at once
HOT = 64  # chunks, and half of all; the windows of a gram that more of them share are dealt out one by one
_U = np.uint64


def _load8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one integer that sorts like them."""
    pad = np.r_[buf, np.zeros(8, np.uint8)]
    return np.ndarray(len(buf), ">u8", pad.tobytes(), strides=(1,)).astype(np.uint64)


def minimisers(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, gram hash) of each run of windows with the same minimiser.

    Windows are named by their first byte; a run never leaves its document.
    """
    span = width - GRAM + 1
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = _load8(buf)
    m = len(buf) - GRAM + 1
    with np.errstate(over="ignore"):
        h = word[:m] * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h += word[8 : m + 8]
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        h += word[GRAM - 8 : m + GRAM - 8]
        h *= _U(0x94D049BB133111EB)
        h ^= h >> _U(29)
    low, have = h, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: n], low[span - have : span - have + n])
    low = low[:n]
    valid = np.zeros(n, bool)
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= width:
            valid[a : b - width + 1] = True
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (h[: n - 1] == low[:-1])
    new[1:] |= valid[1:] != valid[:-1]
    first = off[1:-1]
    new[first[first < n]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, n])
    ok = valid[start]
    # minima are small numbers; mixing them again spreads them over the buckets
    return start[ok], size[ok], mix64(low[start[ok]], 9)


class BlindTrie:
    """A trie over strings that stores only the depth and byte of each branch.

    Inserting goes down by branch bytes alone, compares with one leaf to find the depth where
    the new string leaves, and goes down again to put its branch there.
    """

    __slots__ = ("root", "size")

    def __init__(self, first: bytes, item: int):
        self.root = (first, [item])
        self.size = len(first)

    def insert(self, s: bytes, item: int) -> None:
        node = self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        leaf = node[0]
        if leaf == s:
            node[1].append(item)
            return
        depth = _common(leaf, s)
        parent, edge, node = None, 0, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, edge = node, s[node[0]]
            node = node[1][edge]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = (s, [item])
            return
        fork = [depth, {leaf[depth]: node, s[depth]: (s, [item])}]
        if parent is None:
            self.root = fork
        else:
            parent[1][edge] = fork

    def leaves(self):
        """Items of equal strings, in order of the strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node[1]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _quicksort(word: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Multikey quicksort of suffixes by their first ``depth`` bytes, on eight-byte characters.

    Gives the order, which places begin a group of equal prefixes, and the groups of several
    suffixes. All open segments are partitioned side by side: around the median of three
    characters, or, if they are short, by sorting the characters.
    """
    order = np.arange(len(starts))
    fresh = np.zeros(len(starts), bool)
    fresh[:1] = True
    first, size, at = np.array([0]), np.array([len(starts)]), np.array([0])
    deep: list[tuple[int, int]] = []
    while len(first):
        head = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        place = (first - head)[segment] + np.arange(len(segment))
        own = order[place]
        key = word[starts[own] + at[segment]]
        a, b, c = key[head], key[head + size // 2], key[head + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        side = (key > pivot).astype(np.int8) + (key >= pivot)
        short = size[segment] <= SHORT
        moved = np.empty_like(own)
        new = np.zeros(len(own), bool)
        same = np.zeros(len(own), bool)  # at the start of a part whose characters are equal
        before = 0
        for k in range(3):  # stable partition of the long segments
            mine = np.flatnonzero((side == k) & ~short)
            n = np.bincount(segment[mine], minlength=len(size))
            to = np.repeat(head + before, n) + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
            moved[to] = own[mine]
            begin = (head + before)[n > 0]
            new[begin] = True
            same[begin] = k == 1
            before = before + n
        mine = np.flatnonzero(short)
        inner = mine[np.lexsort((key[mine], segment[mine]))]
        moved[mine] = own[inner]
        step = np.ones(len(mine), bool)
        step[1:] = (segment[mine][1:] != segment[mine][:-1]) | (key[inner][1:] != key[inner][:-1])
        new[mine[step]] = same[mine[step]] = True
        order[place] = moved
        begin = np.flatnonzero(new)
        fresh[place[begin]] = True
        n = np.diff(np.r_[begin, len(own)])
        go = n > 1
        begin, n = begin[go], n[go]
        first, size, at = place[begin], n, at[segment[begin]] + 8 * same[begin]
        done = at >= depth
        deep += zip(first[done].tolist(), (first + size)[done].tolist(), strict=True)
        first, size, at = first[~done], size[~done], at[~done]
    return order, fresh, deep


def deep_shallow(buf: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffix starts sorted by their first ``width`` bytes, equal ones in a group.

    Multikey quicksort down to SHALLOW bytes; groups that agree so far are ordered by blind tries
    over the rest, as long prefixes in common would cost quicksort one pass for each character.
    """
    order, fresh, deep = _quicksort(_load8(buf), starts, SHALLOW)
    raw = buf.tobytes()
    for a, b in deep:
        items = order[a:b].tolist()
        at = starts[items].tolist()
        trie = BlindTrie(raw[at[0] + SHALLOW : at[0] + width], items[0])
        for p, item in zip(at[1:], items[1:], strict=True):
            trie.insert(raw[p + SHALLOW : p + width], item)
        for leaf in trie.leaves():
            fresh[a] = True
            order[a : a + len(leaf)] = leaf
            a += len(leaf)
    return order, np.cumsum(fresh) - 1


def merge_grams(group: pa.Table, hot: int) -> pa.Table:
    """Answer a bucket's key messages: a bit for each key that occurs more than once, and one for each of over ``hot`` chunks."""
    multi, chunks, edges = counted_keys(group)
    return messages(group.column("bucket").to_numpy(), group.column("chunk").to_numpy(), bit_pieces(multi, edges), bit_pieces(chunks > hot, edges))


def deal(raw: bytes, start: np.ndarray, size: np.ndarray, gram: np.ndarray, hot: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, run, bucket) of the stretches of each run: one, or one a window where its gram is hot."""
    n = np.where(hot, size, 1)
    run = np.repeat(np.arange(len(start)), n)
    start = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    bucket = bucket_of(gram[run], buckets)
    own = np.flatnonzero(hot[run])
    bucket[own] = np.fromiter((zlib.crc32(raw[a : a + width]) * buckets >> 32 for a in start[own].tolist()), np.int64, len(own))
    return start, np.where(hot, 1, size)[run], run, bucket


def find_repeats(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text", plan: Plan | None = None, hot: int | None = None) -> DataFrame:
    """(id, n_bytes, removed, kept): byte ranges [from, to) to remove, and the bytes left."""
    if not SHALLOW < width < 2**15:
        raise ValueError(f"width must be from {SHALLOW + 1} to {2**15 - 1}")
    plan = plan or plan_for(docs, text, chunk_mb=1.5, bucket_mb=4.0)
    chunks = chunked(docs, plan, key, text)
    buckets = plan.buckets
    hot = max(HOT, plan.chunks // 2) if hot is None else hot

    def _runs(group: pa.Table):
        ids, buf, off, table = load_chunk(group)
        start, size, gram = minimisers(buf, off, width)
        doc = np.searchsorted(off, start, "right") - 1
        return ids, buf, off, table, start, size, gram, ids[doc]

    def _distinct(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct grams, whether two documents have each, where each run's is)."""
        order = np.lexsort((owner, gram))
        g, o = gram[order], owner[order]
        head = np.ones(len(g), bool)
        head[1:] = g[1:] != g[:-1]
        at = np.cumsum(head) - 1
        multi = np.zeros(int(head.sum()), bool)
        multi[at[1:][(g[1:] == g[:-1]) & (o[1:] != o[:-1])]] = True
        where = np.empty(len(g), np.int64)
        where[order] = at
        return g[head], multi, where

    def ask_grams(group: pa.Table) -> pa.Table:
        *_, gram, owner = _runs(group)
        keys, multi, _ = _distinct(gram & ~_U(1), owner)
        return ask_keys(keys, multi, group.column("chunk")[0].as_py(), buckets)

    def _stretches(group: pa.Table, reply: pa.Table):
        """The chunk's distinct stretches by bucket, and where those of each run are."""
        ids, buf, off, table, start, size, gram, owner = _runs(group)
        gram &= ~_U(1)
        keys, _, where = _distinct(gram, owner)
        n, reply = np.diff(split(bucket_of(keys, buckets))[1]), in_order(reply)
        twice = read_bits(reply.column("keys"), n)[where]
        many = read_bits(reply.column("more"), n)[where][twice]
        raw = buf.tobytes()
        start, size, run, bucket = deal(raw, start[twice], size[twice], gram[twice], many, buckets, width)
        owner = owner[twice][run]
        seen: dict[bytes, int] = {}
        place = np.fromiter((seen.setdefault(raw[s:e], len(seen)) for s, e in zip(start.tolist(), (start + size + width - 1).tolist(), strict=True)), np.int64, len(start))
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, place, owner)
        theirs = np.empty(len(seen), np.int64)
        theirs[place] = bucket
        order = np.argsort(theirs, kind="stable")
        rank = np.empty(len(seen), np.int64)
        rank[order] = np.arange(len(seen))
        texts = list(seen)
        return ids, buf, off, table, start, size, owner, theirs[order], [texts[i] for i in order.tolist()], least[order], rank[place]

    def ask_stretches(group: pa.Table, reply: pa.Table) -> pa.Table:
        if not group.num_rows:
            return no_messages()
        *_, bucket, texts, least, _ = _stretches(group, reply)
        numbers, edges = split(bucket)
        size = np.fromiter(map(len, texts), np.uint16, len(texts))
        at = np.r_[0, np.cumsum(size, dtype=np.int64)]
        return messages(numbers, group.column("chunk")[0].as_py(), pieces(least, edges), pieces(size, edges), pieces(np.frombuffer(b"".join(texts), np.uint8), at[edges]))

    def answer_stretches(group: pa.Table) -> pa.Table:
        """For each stretch, a bit for each of its windows: a smaller id has the same bytes."""
        (owner, off), (size, _), (raw, _) = (column_bytes(group.column(c)) for c in ("keys", "more", "rest"))
        owner, edges, raw = owner.view(np.int64), off // 8, raw.tobytes()
        ends = np.cumsum(size.view(np.uint16), dtype=np.int64)
        texts = [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        where = np.fromiter((seen.setdefault(t, len(seen)) for t in texts), np.int64, len(texts))
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, where, owner)
        size = np.fromiter(map(len, seen), np.int64, len(seen))
        buf = np.frombuffer(b"".join(seen), np.uint8)
        windows = size - width + 1
        head = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), windows)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        order, same = deep_shallow(buf, head[of] + inner, width)
        first = np.full(int(same[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, same, least[of[order]])
        best = np.empty(len(of), np.int64)
        best[order] = first[same]
        begin = np.cumsum(windows) - windows
        # windows of every asked stretch, in the order asked
        n_own = windows[where]
        at = np.repeat(begin[where], n_own) + np.arange(int(n_own.sum())) - np.repeat(np.cumsum(n_own) - n_own, n_own)
        gone = best[at] < np.repeat(owner, n_own)
        upto = np.r_[0, np.cumsum(n_own)]
        return messages(group.column("bucket").to_numpy(), group.column("chunk").to_numpy(), bit_pieces(gone, upto[edges]))

    def cut(group: pa.Table, both: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _result([], [], [], [])
        grams = pc.equal(both.column("kind"), 0)
        ids, buf, off, table, start, size, owner, bucket, texts, least, place = _stretches(group, both.filter(grams))
        n = np.fromiter(map(len, texts), np.int64, len(texts)) - width + 1
        upto = np.r_[0, np.cumsum(n)]
        flags = read_bits(in_order(both.filter(pc.invert(grams))).column("keys"), np.diff(upto[split(bucket)[1]]))
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flag = flags[np.repeat(upto[place], size) + inner] | np.repeat(owner > least[place], size)
        gone_at = (np.repeat(start, size) + inner)[flag]
        gone = cover(np.sort(gone_at), width, len(buf))
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        ranges: list[list[dict]] = [[] for _ in ids]
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while a < b:
                d = int(np.searchsorted(off, a, "right")) - 1
                to = min(b, int(off[d + 1]))
                ranges[d].append({"from": a - int(off[d]), "to": to - int(off[d])})
                a = to
        kept = []
        for raw, cuts in zip(table.column("text").to_pylist(), ranges, strict=True):
            at = [0, *(x for c in cuts for x in (c["from"], c["to"])), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True)) if cuts else raw)
        return _result(table.column("id"), np.diff(off), ranges, kept)

    by_chunk, by_bucket = ["chunk"], ["bucket"]
    grams = chunks.groupBy(*by_chunk).applyInArrow(ask_grams, MESSAGE).groupBy(*by_bucket).applyInArrow(lambda group: merge_grams(group, hot), MESSAGE)
    asked = chunks.groupBy(*by_chunk).cogroup(grams.groupBy(*by_chunk)).applyInArrow(ask_stretches, MESSAGE)
    stretches = asked.groupBy(*by_bucket).applyInArrow(answer_stretches, MESSAGE)
    both = grams.withColumn("kind", F.lit(0)).unionByName(stretches.withColumn("kind", F.lit(1)))
    return chunks.groupBy(*by_chunk).cogroup(both.groupBy(*by_chunk)).applyInArrow(cut, "id long, n_bytes long, removed array<struct<`from`:long,to:long>>, kept binary")


def _result(ids, n, ranges, kept) -> pa.Table:
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64())
    return pa.table({"id": ids, "n_bytes": pa.array(n, pa.int64()), "removed": pa.array(ranges, kind), "kept": pa.array(kept, pa.binary())})


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes, removed bytes and runs, and the digest of the kept bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return find_repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substring(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
dup AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gap AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50 AS new FROM dup),
run AS (SELECT doc_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gap),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
edge AS (SELECT doc_id, r, b, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY r), 2000000000) AS next_a FROM span),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, min(a) AS first_a FROM span GROUP BY doc_id),
piece AS (SELECT d.doc_id, string_agg(substring(h, 2 * b - 1, 2 * (next_a - b)), '' ORDER BY r) AS tail FROM d JOIN edge USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE substring(h, 1, 2 * (first_a - 1)) || tail END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN piece USING (doc_id)
"""
