"""Packed exchange: chunks of documents ask hash buckets about many keys in few rows.

Documents are grouped into chunks of a few MB by a hash. A chunk sends, to each hash bucket that
any of its keys falls in, one row with its distinct keys as bytes; a bucket merges what chunks sent and
answers each row with bits or counts. A key that is in a third of all documents is sent once by
each chunk, so no bucket grows with a hot key. The number of buckets and chunks follows the input, so
neither side outgrows a task; a chunk's work and rows follow its keys, not the number of buckets.
Rows are cut from sorted arrays by offsets, without a step of Python for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import text_bytes
from ._text import column_bytes

MESSAGE = "bucket int, chunk long, keys binary, more binary, rest binary"
NO_ID = np.iinfo(np.int64).max  #: a null id comes after all others
_U = np.uint64


@dataclass(frozen=True)
class Plan:
    chunks: int
    buckets: int


def plan_for(docs: DataFrame, text: str = "text", chunk_mb: float = 2.0, bucket_mb: float = 8.0) -> Plan:
    size = text_bytes(docs, text)
    return Plan(max(16, int(size / (chunk_mb * 2**20))), max(48, int(size / (bucket_mb * 2**20))))


def chunked(docs: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text", together: int | None = None) -> DataFrame:
    """(chunk, id, text) of every document; text as bytes, null as empty.

    Rows are dealt by id, text and the partition they are read in, so that neither a null id nor a
    repeated row fills a chunk. With ``together``, equal rows of that many bytes at least share a chunk.
    """
    body = F.coalesce(F.encode(F.col(f"`{text}`"), "utf-8"), F.lit(b""))
    salt = F.spark_partition_id()
    if together is not None:
        salt = F.when(F.octet_length(body) < together, salt)
    return docs.select(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), salt), F.lit(plan.chunks)).alias("chunk"), F.col(f"`{key}`").cast("long").alias("id"), body.alias("text"))


def load_chunk(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(ids, bytes, offsets, table) of a chunk's rows in order of (id, text)."""
    table = table.combine_chunks()
    raw = table.column("id")
    ids = raw.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    if same.any():
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])))
    table = table.take(pa.array(order)).combine_chunks()
    buf, off = column_bytes(table.column("text"))
    return ids[order], buf, off, table


def placed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 40 bits of the place in it) of 64-bit keys; both rise with the keys."""
    low = (keys & _U(0xFFFFFFFF)) * _U(buckets)
    whole = (keys >> _U(32)) * _U(buckets) + (low >> _U(32))
    return (whole >> _U(32)).astype(np.int64), ((whole & _U(0xFFFFFFFF)) << _U(8)) | ((low >> _U(24)) & _U(0xFF))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return placed(keys, buckets)[0]


def split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers that occur, where each begins and the end) of sorted bucket numbers."""
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return bucket[head], np.r_[head, len(bucket)]


def pieces(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values cut from an array at edges; a 2-d array of bytes is cut by rows."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def bit_pieces(mask: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Bits cut at edges, each piece in whole bytes."""
    size = np.diff(edges)
    at = np.r_[0, np.cumsum((size + 7) // 8)]
    wide = np.zeros(int(at[-1]) * 8, bool)
    wide[np.repeat(at[:-1] * 8 - edges[:-1], size) + np.arange(len(mask))] = mask
    return pieces(np.packbits(wide), at)


def read_bits(column: pa.ChunkedArray | pa.Array, size: np.ndarray) -> np.ndarray:
    """The bits of bit_pieces(), one after another; ``size`` is the number in each piece."""
    buf, off = column_bytes(column)
    flat = np.unpackbits(buf).astype(bool)
    return flat[np.repeat(off[:-1] * 8 - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def messages(bucket: np.ndarray, chunk: int | np.ndarray, keys: pa.Array, more: pa.Array | None = None, rest: pa.Array | None = None) -> pa.Table:
    n = len(bucket)
    nil = pa.nulls(n, pa.binary())
    own = np.full(n, chunk, np.int64) if np.isscalar(chunk) else chunk
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array(own, pa.int64()), "keys": keys, "more": nil if more is None else more, "rest": nil if rest is None else rest})


def no_messages() -> pa.Table:
    return messages(np.zeros(0, np.int64), 0, pa.array([], pa.binary()))


def in_order(reply: pa.Table, by: str = "bucket") -> pa.Table:
    """A chunk's answers in the order of its sorted keys, or what a bucket was asked in order of chunks."""
    return reply.take(pa.array(np.argsort(reply.column(by).to_numpy(), kind="stable"))).combine_chunks()
