"""Substring dedup with difference-cover anchors.

A document's words at positions whose index modulo the period is in a difference cover start an
anchor of a few words. For any two positions there is an offset below the period that puts both
in the cover, so two equal windows of ``window`` words share an aligned anchor. Anchors that occur
once are dropped; around the others the full windows are formed ("extended"), compared by two independent
64-bit hashes of their words, and all but the first in (document id, start) order are removed.

Scale: text shuffles once, to chunks; three steps use that exchange. Anchor hashes and window
hashes travel packed (see _packed), each distinct one once for each chunk. No pairs are formed: a
group of n copies costs n rows, and a hot passage one key for each chunk.

Edge cases: null and empty texts have no words and an empty result; texts shorter than a window
lose nothing; rows with one id are one after another, by a hash of their text, then by their text; a
null id comes last; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._packed import MESSAGE, Plan, bit_pieces, bucket_of, chunked, in_order, load_chunk, messages, no_messages, pieces, plan_for, read_bits, split
from ._text import Words, column_bytes, cover

#: Difference covers by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_ONE = np.uint64(1)


def _anchors(words: Words, hashes: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(word index, hash, width) of the anchors of documents that hold a window."""
    width = window - period + 1
    at, keys = words.windows(hashes, width)
    inside = at - words.doc_off[words.doc[at]]
    chosen = np.isin(inside % period, COVERS[period])
    return at[chosen], keys[chosen], width


def ask_keys(keys: np.ndarray, multi: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """Messages of sorted keys; the last bit of each says whether the chunk has it more than once."""
    numbers, edges = split(bucket_of(keys, buckets))
    return messages(numbers, chunk, pieces(keys | multi, edges))


def counted_keys(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each asked key is had more than once, number of chunks that have it, edges of the messages)."""
    buf, off = column_bytes(group.column("keys"))
    sent = buf.view(np.uint64)
    keys = sent & ~_ONE
    order = np.argsort(keys, kind="stable")
    head = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]][: len(keys)])
    size = np.diff(np.r_[head, len(keys)])
    chunks = np.empty(len(keys), np.int64)
    chunks[order] = np.repeat(size, size)
    return (chunks > 1) | (sent & _ONE).astype(bool), chunks, off // 8


def merge_keys(group: pa.Table) -> pa.Table:
    """Answer a bucket's key messages: one bit for each key, set if it occurs more than once."""
    multi, _, edges = counted_keys(group)
    return messages(group.column("bucket").to_numpy(), group.column("chunk").to_numpy(), bit_pieces(multi, edges))


def find_repeats(docs: DataFrame, window: int = 20, period: int = 7, key: str = "doc_id", text: str = "text", plan: Plan | None = None) -> DataFrame:
    """(id, n_words, removed, kept_text): word ranges [from, to) to remove, and the words left.

    kept_text joins the kept words by one space.
    """
    plan = plan or plan_for(docs, text)
    chunks = chunked(docs, plan, key, text, together=2 * window - 1)
    buckets = plan.buckets

    def ask_anchors(group: pa.Table) -> pa.Table:
        _, buf, off, _ = load_chunk(group)
        words = Words(buf, off)
        keys, n = np.unique(_anchors(words, words.hashes(), window, period)[1] & ~_ONE, return_counts=True)
        return ask_keys(keys, n > 1, group.column("chunk")[0].as_py(), buckets)

    def _windows(words: Words, reply: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, second hash) of the windows around repeated anchors, in order."""
        hashes = words.hashes()
        at, keys, width = _anchors(words, hashes, window, period)
        distinct, where = np.unique(keys & ~_ONE, return_inverse=True)
        size = np.diff(split(bucket_of(distinct, buckets))[1])
        twice = read_bits(in_order(reply).column("keys"), size)[where]
        near = cover(np.maximum(at[twice] - (window - width), 0), window - width + 1, words.n)
        start, one = words.windows(hashes, window)
        pick = near[start]
        if not pick.any():
            return start[pick], one[pick], one[pick]
        _, two = words.windows(words.hashes(12), window, 12)
        return start[pick], one[pick], two[pick]

    def _local(words: Words, reply: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows, with the order of distinct ones by hash and which are first in the chunk."""
        start, one, two = _windows(words, reply)
        order = np.lexsort((start, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        return start, one, two, order[new]

    def ask_windows(group: pa.Table, reply: pa.Table) -> pa.Table:
        if not group.num_rows:
            return no_messages()
        ids, buf, off, _ = load_chunk(group)
        words = Words(buf, off)
        start, one, two, first = _local(words, reply)
        numbers, edges = split(bucket_of(one[first], buckets))
        owner = ids[words.doc[start[first]]]
        return messages(numbers, group.column("chunk")[0].as_py(), pieces(one[first], edges), pieces(two[first], edges), pieces(owner, edges))

    def answer_windows(group: pa.Table) -> pa.Table:
        (one, off), (two, _), (owner, _) = (column_bytes(group.column(c)) for c in ("keys", "more", "rest"))
        one, two, owner, edges = one.view(np.uint64), two.view(np.uint64), owner.view(np.int64), off // 8
        chunk = group.column("chunk").to_numpy()
        order = np.lexsort((np.repeat(chunk, np.diff(edges)), owner, two, one))
        later = np.zeros(len(one), bool)
        later[order[1:]] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        return messages(group.column("bucket").to_numpy(), chunk, bit_pieces(later, edges))

    def cut(group: pa.Table, both: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _result([], [], [], [])
        ids, buf, off, table = load_chunk(group)
        words = Words(buf, off)
        is_anchor = pc.equal(both.column("kind"), 0)
        start, one, _, first = _local(words, both.filter(is_anchor))
        later = read_bits(in_order(both.filter(pc.invert(is_anchor))).column("keys"), np.diff(split(bucket_of(one[first], buckets))[1]))
        keep_first = np.zeros(len(start), bool)
        keep_first[first[~later]] = True
        gone = cover(start[~keep_first], window, words.n)
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        # a run ends at a document's end as well
        ranges: list[list[dict]] = [[] for _ in ids]
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            while a < b:
                d = int(words.doc[a])
                to = min(int(b), int(words.doc_off[d + 1]))
                ranges[d].append({"from": int(a - words.doc_off[d]), "to": int(to - words.doc_off[d])})
                a = to
        texts = []
        for raw, cuts in zip(table.column("text").to_pylist(), ranges, strict=True):
            own = raw.split()
            for c in reversed(cuts):
                del own[c["from"] : c["to"]]
            texts.append(b" ".join(own))
        return _result(table.column("id"), np.diff(words.doc_off), ranges, texts)

    by_chunk, by_bucket = ["chunk"], ["bucket"]
    anchors = chunks.groupBy(*by_chunk).applyInArrow(ask_anchors, MESSAGE).groupBy(*by_bucket).applyInArrow(merge_keys, MESSAGE)
    asked = chunks.groupBy(*by_chunk).cogroup(anchors.groupBy(*by_chunk)).applyInArrow(ask_windows, MESSAGE)
    windows = asked.groupBy(*by_bucket).applyInArrow(answer_windows, MESSAGE)
    both = anchors.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    return chunks.groupBy(*by_chunk).cogroup(both.groupBy(*by_chunk)).applyInArrow(cut, RESULT)


RESULT = "id long, n_words long, removed array<struct<`from`:long,to:long>>, kept_text string"


def _result(ids, n, ranges, texts) -> pa.Table:
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64())
    return pa.table({"id": ids, "n_words": pa.array(n, pa.int64()), "removed": pa.array(ranges, kind), "kept_text": pa.array([t.decode() for t in texts], pa.string())})


def op4_substring_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, removed words, and the digest of the kept ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return find_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
cut AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]), ' ') END) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
