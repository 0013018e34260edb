"""Cross-tokenizer alignment by an event sweep.

Two tokenizers cut the same bytes. Every token is an event at the byte where it ends. The events of both sides are
united, dealt out by document, and sorted by offset within partitions; a machine sweeps over them whose state is the token of
each side that is not yet closed. Each event closes a piece of bytes that lies in one token of either side, which is a link;
an event of both sides closes a group. So the links of a document are its distinct end offsets, its groups the offsets
where both sides end.

Events travel packed: a row holds one side's token ids for a stretch of text, compressed; their offsets are sums
of the ids' byte lengths, and the stretch's own offset is in the row, by which rows are sorted. Stretches end where both sides
must end, or with the text; what a stretch leaves open is carried to the next one. One scan makes the events of both sides,
each distinct unit of text (a space and the printable characters after it) being tokenized once in a worker.

An id pair's count over the corpus takes two sweeps over one exchange. The first counts links by pair for each
chunk of documents and asks the bucket of the pair's second id about its distinct pairs; the bucket adds them up, finds each
second id's highest count, and answers; the second sweep adds counts over each document's links.

Scale: one shuffle of packed events, one of distinct pairs by chunk each way. A pair or a text that occurs very often costs one
entry for each chunk; rows are dealt by id, text and source partition, so copies do not meet in one chunk. A bucket holds the
pairs of some second ids, which the vocabularies bound. Nothing is broadcast.

Edge cases: null and empty texts, and texts whose tokens' bytes differ from a space and the text on either side (such as U+2581,
which one side reads as a space), have no tokens and give zeros; strings of special tokens are plain text; rows with one id
or equal rows stay apart; null ids stay null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._packed import messages, pieces, split
from ._spark import table, text_bytes
from ._text import column_bytes, mix64, slices

EVENTS = "chunk long, row long, id long, at long, side int, n long, ids binary"
RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
PAIRS = "a long, b long, count long, best boolean"
STRETCH = 1 << 18  # characters of a text whose tokens are one row
MOST_CHARS = 1 << 20  # characters that are tokenized together
MOST_UNITS, MOST_IDS = 200_000, 4_000_000  # of a worker's cache
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]|  |\n\n| \n|\n |[ \n]$")


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """The bytes of every id, joined, and where each begins."""

    data: np.ndarray
    off: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Vocabulary:
        return cls(np.frombuffer(b"".join(entries), np.uint8), np.r_[0, np.cumsum([len(e) for e in entries])].astype(np.int64))

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.off)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.off[ids + 1] - self.off[ids]
        return self.data[np.repeat(self.off[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()


class _Numbers(dict):
    """Numbers of units in the order in which they are met."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


#: How byte-level vocabularies cut a text before their merges. A fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenizerPair:
    """Ids of both tokenizers for texts, each distinct unit encoded once.

    A unit begins at a single space between printable characters, where the first tokenizer's pretokenization breaks and no piece of the
    second one reaches across, or at a single line feed between them. The first tokenizer's merges are in order of its ids,
    so its vocabulary is one of ranks, which is read faster; a file whose merges are not is an error.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.two = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a, self.b = vocabularies(a_path, b_path)
        self.one = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=_ranks(a_path), special_tokens={})
        piece = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        self.space = self.two.piece_to_id("▁")
        if any("▁" in p.lstrip("▁") or "\n" in p for p in piece):
            raise ValueError("pieces that reach across spaces or line feeds need another cut of units")
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers()
        self.good = np.zeros(0, bool)
        self.pool = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]
        self.off = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def units(self, text: str) -> list[str]:
        """The units of a text that begins with a space or a line feed."""
        if _OTHER_SPACE.search(text):
            cuts = [0, *(m.start() for m in _BREAK.finditer(text)), len(text)]
            return [text[a:b] for a, b in itertools.pairwise(cuts)]
        return (text[0] + text[1:].replace(" ", "\0 ").replace("\n", "\0\n")).split("\0")

    def _encode(self, units: list[str], raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each unit) of either side."""
        # units that break on both sides are encoded as one text, whose ids are dealt out by their bytes
        whole = [len(u) > 1 and u[0] in " \n" and not u[1].isspace() and not u[-1].isspace() for u in units]
        joined = np.array(self.one.encode_ordinary("".join(itertools.compress(units, whole))), np.uint16)
        size = np.zeros(len(units), np.int64)
        where = np.flatnonzero(whole)
        ends = np.cumsum([len(r) for r in itertools.compress(raw, whole)]).astype(np.int64)
        size[where] = np.diff(np.searchsorted(np.cumsum(self.a.size[joined]), ends, "right"), prepend=0)
        if len(where) < len(units):
            found = np.split(joined, np.cumsum(size[where])[:-1]) if len(where) else []
            found = dict(zip(where.tolist(), found, strict=True))
            for i in range(len(units)):
                if i not in found:
                    found[i] = np.array(self.one.encode_ordinary(units[i]), np.uint16)
                    size[i] = len(found[i])
            joined = np.concatenate([found[i] for i in range(len(units))])
        yield joined, size
        # a line feed is a byte piece, so the space that is put before it stands alone
        two = self.two.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        two = [ids[1:] if u[0] == "\n" and ids[:1] == [self.space] else ids for u, ids in zip(units, two, strict=True)]
        size = np.fromiter(map(len, two), np.int64, len(two))
        yield np.fromiter(itertools.chain.from_iterable(two), np.uint16, int(size.sum())), size

    def _learn(self) -> None:
        units, self.number.new = self.number.new, []
        raw = [u.encode() for u in units]
        good = np.ones(len(units), bool)
        text = b"".join(raw)
        for side, (ids, size) in enumerate(self._encode(units, raw)):
            self.pool[side] = np.r_[self.pool[side], ids]
            self.off[side] = np.r_[self.off[side], self.off[side][-1] + np.cumsum(size)]
            vocabulary = (self.a, self.b)[side]
            edge = np.r_[0, np.cumsum(vocabulary.size[ids])][np.r_[0, np.cumsum(size)]]
            joined = vocabulary.joined(ids)
            if joined != text or not np.array_equal(np.diff(edge), [len(r) for r in raw]):
                good &= [joined[s:e] == r for s, e, r in zip(edge[:-1], edge[1:], raw, strict=True)]
        self.good = np.r_[self.good, good]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(ids of A, ids of B, whether the bytes of both are the text's) of each text."""
        if len(self.number) > MOST_UNITS or len(self.pool[0]) + len(self.pool[1]) > MOST_IDS:
            self._clear()
        own, counts = [], []
        for text in texts:
            units = self.units(text)
            own += units
            counts.append(len(units))
        at = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
        if self.number.new:
            self._learn()
        head = np.r_[0, np.cumsum(counts)]
        ids, edges = [], []
        for off, pool in zip(self.off, self.pool, strict=True):
            size = off[at + 1] - off[at]
            before = np.r_[0, np.cumsum(size)]
            ids.append(pool[np.repeat(off[at] - before[:-1], size) + np.arange(before[-1])])
            edges.append(before[head])
        good = np.logical_and.reduceat(self.good[at], head[:-1])
        for i in range(len(texts)):
            yield *(x[e[i] : e[i + 1]] for x, e in zip(ids, edges, strict=True)), bool(good[i])

    def stretches(self, text: str, most: int = STRETCH) -> Iterator[str]:
        """A text cut where units begin, into about ``most`` characters each."""
        at = 0
        while len(text) - at > most and (cut := _BREAK.search(text, at + most)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]


_KEPT: dict[tuple[str, str], tuple[Vocabulary, Vocabulary]] = {}
_PAIRS: dict[tuple[str, str], TokenizerPair] = {}


def _ranks(path: str) -> dict[bytes, int]:
    """Bytes of every entry of a byte-level vocabulary with its id, which must rise in the order of merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    entries, merges = model["vocab"], model["merges"]
    made = [entries["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if made != sorted(made):
        raise ValueError("ids that do not follow the merges")
    byte = _byte_level()
    return {bytes(byte[c] for c in token): i for token, i in entries.items() if all(c in byte for c in token)}


def vocabularies(a_path: str, b_path: str) -> tuple[Vocabulary, Vocabulary]:
    """Bytes of the ids of a byte-level vocabulary and of a piece model, kept by the worker."""
    if (a_path, b_path) not in _KEPT:
        import sentencepiece

        ranks, two = _ranks(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        pieces_of = [two.id_to_piece(i) for i in range(two.get_piece_size())]
        made = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else b"" if two.is_control(i) or two.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_of)]
        if max(len(by_id), len(made)) > 1 << 16:
            raise ValueError("vocabularies of over 65536 ids need wider ids")
        _KEPT[a_path, b_path] = Vocabulary.of(by_id), Vocabulary.of(made)
    return _KEPT[a_path, b_path]


def _sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte lengths of the ids of both sides, for a sweep; a worker that sweeps has done with tokenizing, so its tokenizers go."""
    _PAIRS.clear()
    one, two = vocabularies(a_path, b_path)
    return one.size, two.size


def _packed(ids: np.ndarray) -> bytes:
    """Ids of 16 bits, compressed."""
    return pa.Codec("zstd", compression_level=3).compress(ids.astype("<u2").tobytes(), asbytes=True)


def _unpacked(data: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 2 * n, "zstd"), "<u2") if n else np.zeros(0, np.uint16)


def events(docs: DataFrame, a_path: str, b_path: str, chunks: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed end events of both sides: (chunk, row, id, at, side, n, ids); a text without tokens has one row of no side."""
    own = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.spark_partition_id()), F.lit(chunks)).alias("chunk"),
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"),
    )

    def groups(pair: TokenizerPair, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """(documents, stretches) of about MOST_CHARS characters."""
        rows, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for part in pair.stretches(" " + text) if text else ():
                rows.append(i)
                parts.append(part)
                size += len(part)
                if size > MOST_CHARS:
                    yield rows, parts
                    rows, parts, size = [], [], 0
        if rows:
            yield rows, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _PAIRS:
            _PAIRS[a_path, b_path] = TokenizerPair(a_path, b_path)
        pair = _PAIRS[a_path, b_path]
        for whole in batches:
            for part in slices(whole, "text"):
                found: list[list | None] = [[] for _ in range(part.num_rows)]  # None: bytes differ
                at = [0] * part.num_rows
                for rows, parts in groups(pair, part.column(3).to_pylist()):
                    for i, (a, b, good) in zip(rows, pair.encode(parts), strict=True):
                        if not good:
                            found[i] = None
                        elif found[i] is not None:
                            found[i] += [(at[i], 0, len(a), _packed(a)), (at[i], 1, len(b), _packed(b))]
                            at[i] += int(pair.a.size[a].sum())
                found = [f or [(0, -1, 0, b"")] for f in found]
                every = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                cells = list(zip(*(e for f in found for e in f), strict=True))
                made = [pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(every) for i in range(3)), *made], ["chunk", "row", "id", "at", "side", "n", "ids"])

    return own.mapInArrow(run, EVENTS)


class Sweep:
    """The machine: takes ids of either side as they come, gives what is closed; what is open on one side waits."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes = sizes
        self.open = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]

    def put(self, side: int, ids: np.ndarray) -> None:
        self.open[side] = np.concatenate([self.open[side], ids]) if len(self.open[side]) else ids

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids of A, ids of B, ends of A, ends of B) up to the last offset where both end, from the first open one on."""
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, self.open, strict=True)]
        if not len(ends[0]) or not len(ends[1]):
            return None
        if ends[0][-1] == ends[1][-1]:
            cut = len(ends[0]), len(ends[1])
        else:
            both = np.intersect1d(*ends, assume_unique=True)
            if not len(both):
                return None
            cut = tuple(int(np.searchsorted(e, both[-1], "right")) for e in ends)
        out = self.open[0][: cut[0]], self.open[1][: cut[1]], ends[0][: cut[0]], ends[1][: cut[1]]
        self.open = [self.open[0][cut[0] :], self.open[1][cut[1] :]]
        return out


def _ended(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte but the last, and the last: whether a token of A, of B ends with it."""
    one, two = np.zeros(int(a_ends[-1]), bool), np.zeros(int(b_ends[-1]), bool)
    one[a_ends - 1] = two[b_ends - 1] = True
    return one, two


def links_of(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Pairs (A id, B id) of the links, as one number each: the open tokens at every event."""
    one, two = _ended(a_ends, b_ends)
    at = np.flatnonzero(one | two)
    i, j = np.cumsum(one[at]) - one[at], np.cumsum(two[at]) - two[at]
    return a[i].astype(np.uint32) << np.uint32(16) | b[j]


_DIGITS: np.ndarray | None = None


def _digits() -> np.ndarray:
    """Eight bytes for each id of 16 bits: its decimal digits, room for a separator, zeros in between."""
    global _DIGITS
    if _DIGITS is None:
        wide = np.zeros((1 << 16, 8), np.uint8)
        wide[:, :5] = np.arange(1 << 16).astype("S5").view(np.uint8).reshape(-1, 5)
        _DIGITS = wide.view(np.uint64).ravel()
    return _DIGITS


def groups_text(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[int, bytes]:
    """(number of groups, ``a1,a2|b1;a3|b2`` with a semicolon after each group)."""
    one, two = _ended(a_ends, b_ends)
    both = one & two
    group = np.cumsum(both) - both  # of a byte
    last_a, last_b = both[a_ends - 1], both[b_ends - 1]
    ga, gb = group[a_ends - 1], group[b_ends - 1]
    n = int(ga[-1]) + 1
    count_a, count_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    at_a = np.arange(len(a)) + (np.cumsum(count_b) - count_b)[ga]
    at_b = np.arange(len(b)) + np.cumsum(count_a)[gb]
    out = np.empty(len(a) + len(b), np.uint64)
    table = _digits()
    shift = np.uint64(40)
    out[at_a] = table[a] | (np.where(last_a, ord("|"), ord(",")).astype(np.uint64) << shift)
    out[at_b] = table[b] | (np.where(last_b, ord(";"), ord(",")).astype(np.uint64) << shift)
    flat = out.view(np.uint8)
    return n, flat[flat != 0].tobytes()


def _counted(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and how often each occurs."""
    pairs, place = np.unique(np.concatenate(parts), return_inverse=True)
    return pairs, np.bincount(place, np.concatenate(counts), len(pairs)).astype(np.int64)


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair: one for all pairs of a second id."""
    return (mix64((pairs & np.uint32(0xFFFF)).astype(np.uint64), 81) % np.uint64(buckets)).astype(np.int64)


def _asked(chunk: int, pairs: np.ndarray, count: np.ndarray, buckets: int) -> pa.Table:
    where = _bucket(pairs, buckets)
    order = np.lexsort((pairs, where))
    numbers, edges = split(where[order])
    return messages(numbers, chunk, pieces(pairs[order], edges), pieces(count[order], edges))


MESSAGE = "bucket int, chunk long, keys binary, more binary, rest binary"


def count_pairs(ordered: DataFrame, a_path: str, b_path: str, buckets: int) -> DataFrame:
    """Messages of each chunk's distinct pairs and counts, by one sweep over sorted events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(a_path, b_path)
        chunk = row = sweep = None
        parts, counts, waiting = [], [], 0

        def fold() -> None:
            nonlocal parts, counts, waiting
            pairs, count = _counted(parts, counts)
            parts, counts, waiting = [pairs], [count], 0

        for batch in batches:
            for own_chunk, own_row, side, n, ids in zip(*(batch.column(c).to_pylist() for c in ("chunk", "row", "side", "n", "ids")), strict=True):
                if own_chunk != chunk:
                    if parts:
                        fold()
                        yield from _asked(chunk, parts[0], counts[0], buckets).to_batches()
                    chunk, parts, counts, waiting = own_chunk, [], [], 0
                if own_row != row:
                    row, sweep = own_row, Sweep(sizes)
                if side < 0:
                    continue
                sweep.put(side, _unpacked(ids, n))
                if side and (done := sweep.closed()):
                    parts.append(links_of(*done))
                    counts.append(np.ones(len(parts[-1]), np.int64))
                    waiting += len(parts[-1])
                    if waiting > 1 << 20:
                        fold()
        if parts:
            fold()
            yield from _asked(chunk, parts[0], counts[0], buckets).to_batches()

    return ordered.mapInArrow(run, MESSAGE)


def _summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(asked pairs, edges by message, distinct pairs, their counts, whether a count is its second id's highest)."""
    (keys, off), (more, _) = column_bytes(group.column("keys")), column_bytes(group.column("more"))
    asked = keys.view(np.uint32)
    pairs, count = _counted([asked], [more.view(np.int64)])
    second = pairs & np.uint32(0xFFFF)
    highest = np.zeros(1 << 16, np.int64)
    np.maximum.at(highest, second, count)
    return asked, off // 4, pairs, count, count == highest[second]


def _plan(docs: DataFrame, text: str, chunk_mb: float) -> tuple[int, int, int]:
    """(chunks, partitions, buckets) that follow the input."""
    size = text_bytes(docs, text)
    chunks = max(16, int(size / (chunk_mb * 2**20)))
    return chunks, max(16, int(size / (32 * 2**20))), max(16, int(size / (64 * 2**20)))


def _dealt(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, chunk_mb: float) -> tuple[DataFrame, DataFrame, int]:
    """(events by chunk, messages of counted pairs, buckets)."""
    chunks, parts, buckets = _plan(docs, text, chunk_mb)
    dealt = events(docs, a_path, b_path, chunks, key, text).repartition(parts, "chunk")
    ordered = dealt.sortWithinPartitions("chunk", "row", "at", "side")
    return dealt, count_pairs(ordered, a_path, b_path, buckets), buckets


def linked_ids(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", chunk_mb: float = 2.0) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold each id pair, and whether that is the second id's highest."""

    def totals(group: pa.Table) -> pa.Table:
        _, _, pairs, count, best = _summed(group)
        return pa.table({"a": (pairs >> np.uint32(16)).astype(np.int64), "b": (pairs & np.uint32(0xFFFF)).astype(np.int64), "count": count, "best": best})

    _, asked, _ = _dealt(docs, a_path, b_path, key, text, chunk_mb)
    return asked.groupBy("bucket").applyInArrow(totals, PAIRS)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", chunk_mb: float = 2.0) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document."""
    dealt, asked, _ = _dealt(docs, a_path, b_path, key, text, chunk_mb)

    def answer(group: pa.Table) -> pa.Table:
        pairs_asked, edges, pairs, count, best = _summed(group)
        at = np.searchsorted(pairs, pairs_asked)
        return messages(group.column("bucket").to_numpy(), group.column("chunk").to_numpy(), pieces(pairs_asked, edges), pieces(count[at], edges), pieces(best[at], edges))

    def rows(group: pa.Table, reply: pa.Table) -> Iterator[tuple]:
        sizes = _sizes(a_path, b_path)
        (keys, _), (more, _), (rest, _) = (column_bytes(reply.column(c)) for c in ("keys", "more", "rest"))
        pairs = keys.view(np.uint32)
        order = np.argsort(pairs, kind="stable")
        pairs, count, best = pairs[order], more.view(np.int64)[order], rest.view(bool)[order]
        group = group.sort_by([("row", "ascending"), ("at", "ascending"), ("side", "ascending")])
        cells = zip(*(group.column(c).to_pylist() for c in ("row", "id", "side", "n")), group.column("ids"), strict=True)
        row = None
        for own_row, own_id, side, n, ids in cells:
            if own_row != row:
                if row is not None:
                    yield made
                row, sweep, made = own_row, Sweep(sizes), [own_id, 0, 0, 0, 0, 0, 0, []]
            if side < 0:
                continue
            sweep.put(side, _unpacked(ids.as_buffer(), n))
            if side and (done := sweep.closed()):
                links, times = np.unique(links_of(*done), return_counts=True)
                at = np.searchsorted(pairs, links)
                groups, text = groups_text(*done)
                for k, more in enumerate((len(done[0]), len(done[1]), groups, int(times.sum()), int(times[best[at]].sum()), int(times @ count[at])), 1):
                    made[k] += more
                made[7].append(text)
        if row is not None:
            yield made

    def result(group: pa.Table, reply: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({c: pa.array([], pa.string() if c == "groups" else pa.int64()) for c in names})
        cells = list(zip(*rows(group, reply), strict=True))
        texts = pa.array([b"".join(t)[:-1].decode() for t in cells[7]], pa.string())
        return pa.table(dict(zip(names, [*(pa.array(c, pa.int64()) for c in cells[:7]), texts], strict=True)))

    names = [c.split()[0] for c in RESULT.split(", ")]
    answers = asked.groupBy("bucket").applyInArrow(answer, MESSAGE)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(result, RESULT)


def op11_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links of two public tokenizers, and the digest of its groups."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
