"""Token-id output with an adaptive context-mixing range coder.

Texts are tokenized in ascending id order. The ids of a run of documents (a segment) become symbols:
units of text that are frequent in the segment are one symbol each, a phrase of ids; others are
spelled by their ids, of which frequent neighbours are joined to phrases too. The symbols are cut
into blocks, and a block is coded on its own: its state starts anew and a checksum follows. The
probability of a symbol is one mixture of three predictions: order-0 shares of the segment, order-1
shares of the symbols that follow the one before, and the symbol that came last after the two before
in this block (order 2). The mixture's weights depend on how well the order-1 shares cover the
context and on how often the order-2 prediction held; they adapt with every symbol, by what each
prediction gave to the one that came. Phrases and shares of order 0 and 1 are counted over the
segment and written once before its blocks, so that blocks start with them.

The file format is a Parquet table with one row for each segment: document ids, ids per document,
block length, phrases with shares, coded blocks, and a CRC-32 of each block's ids. Rows carry their
partition and place, so the order is known when they are read back.

Scale: one range shuffle by id; tokenizing, coding and decoding are per partition. All blocks of a
segment are coded at once, an array operation over blocks for each step, so cost does not depend
on Python's speed for one symbol. Document offsets come from levels of sums over segments, so no
window holds more than a share of them.

Edge cases: a null or empty text is the end id alone; very long texts span blocks; null ids come
first; rows with one id stay apart, in order of a hash of their text, and may fill several
partitions; extra columns are ignored; an empty table writes no rows; a segment with MOST_IDS
distinct ids or more is an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import shared_path, small_batches, text_bytes

BLOCK = 1024  # symbols
SEGMENT = 16 << 20  # bytes of a segment's texts, at most
SLOTS = 512  # of the order-2 table of a block
MOST_IDS = 1 << 17  # symbols of a segment: ids and phrases
PHRASES, OFTEN, LONGEST = 1 << 16, 8, 255  # phrases of a segment at most, how often each occurs at least, and its ids at most
JOINS = 2  # passes that join the ids of rare units
MOST_NEXT = 15  # symbols that an order-1 context keeps shares of, the most frequent ones; order 0 codes the others
LEAST_KEPT = 0.2  # of a context's occurrences are followed by these, or it has no shares
#: Bits of the shares of order 0 and 1, of the weights in the mixture, and of the weights as they are kept.
_ZERO, _ONE, _MIX, _FINE = 18, 12, 12, 16
_TOTAL = _ZERO + _MIX
_LEAST = 1 << 10  # fine weight that order 0 has at least
_RATE = 5  # weights move by 1/32
_U = np.uint64
_BOTTOM, _WORD = _U(1 << 32), _U(32)
_LOW = (1 << 32) - 1
FORMAT = "part int, segment int, doc_ids array<long>, n_ids array<long>, block int, last int, shares binary, blocks array<binary>, sums array<long>"


class Encoder:
    """Range coders side by side, one for each lane: 64-bit range, 32-bit output, carries added to what is out."""

    def __init__(self, lanes: int, room: int):
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, 2**64 - 1, _U)
        self.out = np.zeros(lanes * room, np.uint32)
        self.start = np.arange(lanes) * room
        self.at = self.start.copy()

    def put(self, n: int, cum: np.ndarray, freq: np.ndarray) -> None:
        """Code the shares [cum, cum + freq) of 2 ** _TOTAL in the first n lanes."""
        low, rng, at = self.low[:n], self.range[:n], self.at[:n]
        rng >>= _U(_TOTAL)
        step = rng * cum.view(_U)
        low += step
        rng *= freq.view(_U)
        carry = np.flatnonzero(low < step)
        to = at[carry] - 1
        while len(to):
            self.out[to] += np.uint32(1)
            to = to[self.out[to] == 0] - 1
        small = rng < _BOTTOM
        self.out[at] = low >> _WORD  # overwritten later where the lane stays
        at += small
        shift = small * _WORD
        low <<= shift
        rng <<= shift

    def done(self) -> list[bytes]:
        self.out[self.at] = self.low >> _WORD
        self.out[self.at + 1] = self.low & _U(_LOW)
        return [self.out[a : b + 2].astype(">u4").tobytes() for a, b in zip(self.start.tolist(), self.at.tolist(), strict=True)]


class Decoder:
    def __init__(self, blocks: list[bytes]):
        size = np.array([len(b) // 4 for b in blocks])
        self.data = np.r_[np.frombuffer(b"".join(blocks), ">u4"), np.zeros(4, np.uint32)].astype(_U)
        self.at = np.cumsum(size) - size
        self.code = (self.data[self.at] << _WORD) | self.data[self.at + 1]  # above low
        self.at += 2
        self.range = np.full(len(blocks), 2**64 - 1, _U)

    def target(self, n: int) -> np.ndarray:
        """The share that the next symbol's interval holds; take() must follow."""
        rng = self.range[:n]
        rng >>= _U(_TOTAL)
        return np.minimum(self.code[:n] // rng, _U((1 << _TOTAL) - 1)).view(np.int64)

    def take(self, n: int, cum: np.ndarray, freq: np.ndarray) -> None:
        rng, code, at = self.range[:n], self.code[:n], self.at[:n]
        code -= rng * cum.view(_U)
        rng *= freq.view(_U)
        small = rng < _BOTTOM
        shift = small * _WORD
        rng <<= shift
        code <<= shift
        code |= self.data.take(at, mode="clip") * small
        at += small


def _to_total(count: np.ndarray, group: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """Counts as shares of ``total`` in each group, one at least; the first place of a group takes what is left."""
    n = np.bincount(group, minlength=len(first))
    all_ = np.bincount(group, weights=count, minlength=len(first))
    out = 1 + (count * ((total - n) / np.maximum(all_, 1))[group]).astype(np.int64)
    out[first[n > 0]] += (total - np.bincount(group, weights=out, minlength=len(first)).astype(np.int64))[n > 0]
    return out


def _dealt(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _spread(values: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values[start[w] : start[w] + size[w]] of every w in which, one after the other; a few at a time, so that no large array is made on the way."""
    out = np.empty(int(size[which].sum()), values.dtype)
    at = 0
    for i in range(0, len(which), 1 << 14):
        some = which[i : i + (1 << 14)]
        got = values[_dealt(start[some], size[some])]
        out[at : at + len(got)] = got
        at += len(got)
    return out


def _mark(code: np.ndarray) -> np.ndarray:
    """20 bits of a pair's code."""
    return (code * 0x1E3779B97F4A7C15) >> 43 & (1 << 20) - 1


class Shares:
    """Symbols of a segment with their order-0 and order-1 shares.

    Symbol s stands for the ids ``ids[off[s]:off[s + 1]]``; the number after the last symbol is the
    context of a block's first one. A context has a row of up to MOST_NEXT symbols that follow it, in
    order; row 0 is that of contexts without. Place k of a row (0 to MOST_NEXT) is behind k of its
    symbols, and q is 2 (row (MOST_NEXT + 1) + k), and 1 more at the row's k-th symbol itself. ``at_0``
    and ``at_1`` hold (shares below, shares) of a symbol and of a q as one number, 32 bits each.
    """

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, f0: np.ndarray, row_len: np.ndarray, cover: np.ndarray, sym: np.ndarray, f1: np.ndarray):
        self.sizes, self.ids, self.f0, self.row_len, self.sym, self.f1 = sizes, ids, f0, row_len, sym, f1
        self.off = np.cumsum(sizes) - sizes
        size, wide = len(sizes), MOST_NEXT + 1
        c0 = np.cumsum(f0) - f0
        self.at_0 = c0 << 32 | f0
        self.cover = cover * 4
        has = row_len > 0
        self.row = np.where(has, np.cumsum(has), 0) * wide
        rows = int(has.sum()) + 1
        to = _dealt(self.row[has], row_len[has])  # of each entry
        up = f1 << (_ZERO - _ONE)
        every = np.cumsum(up)
        first = np.cumsum(row_len[has]) - row_len[has]
        c1 = every - np.repeat((every - up)[first], row_len[has])  # with the entry itself
        whole = np.full(rows * wide, 1 << _ZERO)
        self.r_sym, self.r_c0, self.r_c1 = np.full(rows * wide, size, np.int32), whole.astype(np.int32), whole.astype(np.int32)
        self.r_sym[to], self.r_c0[to], self.r_c1[to] = sym, c0[sym], c1 - up
        self.at_1 = np.zeros(2 * rows * wide, np.int64)
        self.at_1[2 * to + 2] = c1 << 32
        self.at_1[2 * to + 3] = c1 - up << 32 | up

    def place(self, context: np.ndarray, x: np.ndarray) -> np.ndarray:
        """q of each symbol x after its context."""
        q = np.empty(len(x), np.int32)
        for i in range(0, len(x), 1 << 15):
            base, own = self.row.take(context[i : i + (1 << 15)]) - 1, x[i : i + (1 << 15)]
            at, step = base.copy(), (MOST_NEXT + 1) // 2
            while step:
                at += (self.r_sym.take(at + step) <= own) * step
                step >>= 1
            q[i : i + (1 << 15)] = 2 * at + 2 + ((self.r_sym.take(at, mode="clip") == own) & (at > base))
        return q

    @classmethod
    def of(cls, x: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int) -> tuple[Shares, np.ndarray]:
        """(shares of the symbols x, q of each one)."""
        size = len(sizes)
        if size >= MOST_IDS:
            raise ValueError(f"{MOST_IDS} distinct ids or more")
        count = np.bincount(x, minlength=size)
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[::block] = size
        total = np.bincount(before, minlength=size + 1)
        least = max(2, len(x) >> 18)
        mark = np.empty(len(x), np.int32)
        for i in range(0, len(x), 1 << 14):
            j = i + (1 << 14)
            mark[i:j] = _mark(before[i:j].astype(np.int64) << 20 | x[i:j])
        often = np.flatnonzero((np.bincount(mark, minlength=1 << 20) >= least).take(mark))  # or another pair of that mark is
        del mark
        pairs, n = np.unique(before[often].astype(np.int64) * size + x[often], return_counts=True)
        pairs, n = pairs[n >= least], n[n >= least]
        row, sym = pairs // size, pairs % size
        order = np.lexsort((-n, row))
        r = row[order]
        order = np.sort(order[np.arange(len(order)) - np.searchsorted(r, r) < MOST_NEXT])
        row, sym, n = row[order], sym[order], n[order]
        kept = np.bincount(row, weights=n, minlength=size + 1) / np.maximum(total, 1)
        of_use = kept[row] >= LEAST_KEPT
        row, sym, n = row[of_use], sym[of_use], n[of_use]
        row_len = np.bincount(row, minlength=size + 1)
        f1 = _to_total(n, row, np.cumsum(row_len) - row_len, 1 << _ONE)
        cover = np.where(row_len == 0, 0, 1 + (kept >= 0.6) + (kept >= 0.9))
        f0 = _to_total(count, np.zeros(size, np.int64), np.array([int(np.argmax(count))]), 1 << _ZERO)
        shares = cls(sizes, ids, f0, row_len, cover, sym, f1)
        return shares, shares.place(before, x)

    def pack(self) -> bytes:
        head = np.array([len(self.sizes), len(self.ids), len(self.sym)], np.int64)
        kinds = ((head, np.int64), (self.sizes, np.uint8), (self.ids, np.uint32), (self.f0, np.uint32), (self.row_len, np.uint8), (self.cover, np.uint8), (np.diff(self.sym, prepend=0), np.int32), (self.f1, np.uint16))
        return zlib.compress(b"".join(_planes(a.astype(k)) for a, k in kinds), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Shares:
        data, at = zlib.decompress(data), 0

        def part(n: int, kind: type) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            out = np.frombuffer(data, np.uint8, size, at).reshape(np.dtype(kind).itemsize, n).T
            at += size
            return np.ascontiguousarray(out).view(kind).ravel().astype(np.int64)

        n, ids, m = part(3, np.int64)
        sizes, ids, f0 = part(n, np.uint8), part(ids, np.uint32), part(n, np.uint32)
        row_len, cover = part(n + 1, np.uint8), part(n + 1, np.uint8) >> 2
        return cls(sizes, ids, f0, row_len, cover, np.cumsum(part(m, np.int32)), part(m, np.uint16))


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, first bytes of all values first."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


class Mixture:
    """The state of each lane: the weights of order 1 and 2 by kind of context, and the order-2 table.

    A word of the table holds the q, the symbol before, the symbol and the confidence (1 to 3) of a prediction; 0 is none.
    """

    def __init__(self, lanes: int, shares: Shares):
        self.s = shares
        one, two = np.array([0.0, 0.4, 0.7, 0.9]), np.array([0.0, 0.05, 0.3, 0.6])
        first_two = np.tile(two, 4) * (1 << _FINE)
        first_one = np.repeat(one, 4) * ((1 << _FINE) - first_two)
        self.one = np.tile(first_one.astype(np.int64), lanes)
        self.two = np.tile(first_two.astype(np.int64), lanes)
        self.least_one, self.least_two = (np.where(w > 0, 256, 0) for w in (first_one, first_two))
        self.table = np.zeros(lanes * SLOTS, np.int64)
        self.lane_slot, self.lane_kind = np.arange(lanes) * SLOTS, np.arange(lanes) * 16
        self.last = np.full(lanes, len(shares.sizes), np.int64)
        self.before = self.last.copy()

    def predict(self, n: int) -> None:
        last = self.last[:n]
        self.slot = self.lane_slot[:n] + ((self.before[:n] * 0x9E3779B1 + last * 0x85EBCA6B >> 12) & (SLOTS - 1))
        word = self.table.take(self.slot)
        word *= (word >> 19) & (2 * MOST_IDS - 1) == last  # of another symbol before: none
        sure = word & 3
        kind = self.s.cover.take(last) + sure
        # lanes whose context has no shares and that have no prediction are left to order 0; their weights stay
        self.on = np.flatnonzero(kind)
        self.kind, self.sure, self.word = kind.take(self.on), sure.take(self.on), word.take(self.on)
        self.guess = (self.word >> 2) & (MOST_IDS - 1)
        self.weight = self.lane_kind.take(self.on) + self.kind
        self.fine_one, self.fine_two = self.one.take(self.weight), self.two.take(self.weight)
        self.w1, w2 = self.fine_one >> (_FINE - _MIX), self.fine_two >> (_FINE - _MIX)
        self.w0 = (1 << _MIX) - self.w1 - w2
        self.point = w2 << _ZERO  # what order 2 gives to its prediction; without one, 0

    def interval(self, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares below x, shares of x) in the mixture."""
        on = self.on
        both = self.s.at_0.take(x)
        own, one = x.take(on), self.s.at_1.take(q.take(on))
        one *= self.w1
        self.g1 = one & _LOW
        one += self.w0 * both.take(on)
        self.hit = self.guess == own
        self.g2 = self.point * self.hit
        self.all = (one & _LOW) + self.g2
        low, freq = both >> (32 - _MIX), both & _LOW
        low &= -1 << _MIX
        freq <<= _MIX
        low[on] = (one >> 32) + self.point * (self.guess < own)
        freq[on] = self.all
        return low, freq

    def find(self, n: int, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, q) whose interval holds the target."""
        s, on = self.s, self.on
        x, q = s.by_share.take(target >> _MIX), np.zeros(n, np.int64)
        t, w0, w1, row = target.take(on), self.w0, self.w1, s.row.take(self.last.take(on))
        guess, guess_q = self.guess, self.word >> 37
        has = self.sure > 0
        both = w0 * s.at_0.take(guess) + w1 * s.at_1.take(guess_q)
        low = both >> 32
        above = t >= low + (both & _LOW) + self.point
        hit = has & (t >= low) & ~above
        t -= self.point * (has & above)
        at, step = row - 1, (MOST_NEXT + 1) // 2
        while step:
            to = at + step
            at += (w0 * s.r_c0.take(to) + w1 * s.r_c1.take(to) <= t) * step
            step >>= 1
        place = 2 * at + 2
        sym = s.r_sym.take(at, mode="clip")
        both = w0 * s.at_0.take(sym, mode="clip") + w1 * s.at_1.take(place + 1)
        exact = (t < (both >> 32) + (both & _LOW)) & (at >= row)
        # the whole part of this division is right, as both numbers are small
        other = s.by_share.take(((t - w1 * (s.at_1.take(place) >> 32)) / w0).astype(np.int64), mode="clip")
        x[on] = np.where(hit, guess, np.where(exact, sym, other))
        q[on] = np.where(hit, guess_q, place + exact)
        return x, q

    def learn(self, n: int, x: np.ndarray, q: np.ndarray) -> None:
        # single divisions of whole numbers are rounded the same way everywhere, so both sides agree
        unit = (1 << _FINE) / self.all
        one = self.fine_one + (((self.g1 * unit).astype(np.int64) - self.fine_one) >> _RATE)
        two = self.fine_two + (((self.g2 * unit).astype(np.int64) - self.fine_two) >> _RATE)
        two = np.minimum(np.maximum(two, self.least_two.take(self.kind)), (1 << _FINE) - _LEAST - 256)
        one = np.maximum(one, self.least_one.take(self.kind))
        self.two[self.weight] = two
        self.one[self.weight] = np.minimum(one, (1 << _FINE) - _LEAST - two)
        last = self.last[:n]
        word = (q << 37) | (last << 19) | (x << 2) | 1
        word[self.on] += np.minimum(self.sure * self.hit, 2)
        self.table[self.slot] = word
        self.before[:n] = last
        last[:] = x


def encode_symbols(x: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int) -> tuple[bytes, list[bytes]]:
    """(packed shares, coded blocks of ``block`` symbols, the last one shorter)."""
    shares, q = Shares.of(x, sizes, ids, block)
    lanes = -(-len(x) // block)
    by_step = lambda a: np.ascontiguousarray(np.r_[a, np.zeros(lanes * block - len(a), a.dtype)].reshape(lanes, block).T)
    last = len(x) - (lanes - 1) * block
    model, coder = Mixture(lanes, shares), Encoder(lanes, min(block, len(x)) + 4)
    x, q = by_step(x), by_step(q)
    for t in range(min(block, len(x) if lanes == 1 else block)):
        n = lanes if t < last else lanes - 1
        own, place = x[t, :n].astype(np.int64), q[t, :n].astype(np.int64)
        model.predict(n)
        coder.put(n, *model.interval(own, place))
        model.learn(n, own, place)
    return shares.pack(), coder.done()


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """encode_symbols() of ids without phrases."""
    if not len(ids):
        return b"", []
    count = np.bincount(ids)
    alphabet = np.flatnonzero(count)
    name = np.zeros(len(count), np.int32)
    name[alphabet] = np.arange(len(alphabet))
    return encode_symbols(name[ids], np.ones(len(alphabet), np.int64), alphabet, block)


def decode_symbols(packed: bytes, blocks: list[bytes], last: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each block)."""
    shares = Shares.unpack(packed)
    lanes = len(blocks)
    length = block if lanes > 1 else last
    out = np.zeros((length, lanes), np.int32)
    model, coder = Mixture(lanes, shares), Decoder(blocks)
    shares.by_share = np.repeat(np.arange(len(shares.sizes)), shares.f0)
    for t in range(length):
        n = lanes if t < last else lanes - 1
        model.predict(n)
        x, q = model.find(n, coder.target(n))
        coder.take(n, *model.interval(x, q))
        out[t, :n] = x
        model.learn(n, x, q)
    x = out.T.ravel()[: (lanes - 1) * block + last]
    sizes = shares.sizes[x]
    return _spread(shares.ids.astype(np.uint32), shares.off, shares.sizes, x), np.add.reduceat(sizes, np.arange(0, len(x), block))


def decode_blocks(packed: bytes, blocks: list[bytes], last: int, block: int = BLOCK) -> np.ndarray:
    """The ids of encode_blocks(); ``last`` is the length of the last block."""
    return decode_symbols(packed, blocks, last, block)[0] if blocks else np.zeros(0, np.uint32)


def phrased(unit: np.ndarray, off: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of a text given as units, ids of each symbol, the ids of all symbols).

    Unit u stands for the ids pool[off[u]:off[u + 1]]. Frequent units are symbols. Others are spelled by
    their ids, of which frequent neighbours are joined, the most frequent ones first.
    """
    size = np.diff(off)
    count = np.bincount(unit, minlength=len(size))
    whole = np.flatnonzero((count >= OFTEN) & (size > 1) & (size <= LONGEST))
    room = max(0, min(PHRASES, MOST_IDS - 1 - np.count_nonzero(np.bincount(pool))))
    if len(whole) > room:
        whole = np.sort(whole[np.argsort(-count[whole], kind="stable")[:room]])
    is_whole = np.zeros(len(size), bool)
    is_whole[whole] = True
    rest = np.flatnonzero(~is_whole & (size > 0))
    spelled = pool[_dealt(off[rest], size[rest])]
    alphabet = np.flatnonzero(np.bincount(spelled)) if len(spelled) else np.zeros(0, np.int64)
    name = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 0, np.int64)
    name[alphabet] = np.arange(len(alphabet))
    spelled, of = name[spelled], np.repeat(np.arange(len(rest)), size[rest])
    sizes, ids, room = np.ones(len(alphabet), np.int64), alphabet, room - len(whole)
    often_rest = count[rest]
    for _ in range(JOINS):
        code = spelled[:-1] << 20 | spelled[1:]
        mark = _mark(code)
        inside = of[1:] == of[:-1]
        n = np.bincount(mark, weights=often_rest[of[1:]] * inside, minlength=1 << 20).take(mark) * inside
        n = np.r_[0, np.where(n >= 2 * OFTEN, n, 0), 0]
        at = np.flatnonzero((n[1:-1] > n[:-2]) & (n[1:-1] >= n[2:]))  # so no two are neighbours
        pairs, which = np.unique(code[at], return_inverse=True)
        often = np.bincount(which, weights=often_rest[of[at]], minlength=len(pairs)) >= OFTEN
        left, right = pairs >> 20, pairs & (1 << 20) - 1
        often &= (sizes[left] + sizes[right] <= LONGEST) & (np.cumsum(often) <= room)
        at, which = at[often[which]], which[often[which]]
        left, right = left[often], right[often]
        room -= len(left)
        spelled[at] = len(sizes) + (np.cumsum(often) - 1)[which]
        stay = np.ones(len(spelled), bool)
        stay[at + 1] = False
        spelled, of = spelled[stay], of[stay]
        both = np.c_[left, right].ravel()
        ids = np.r_[ids, ids[_dealt((np.cumsum(sizes) - sizes)[both], sizes[both])]]
        sizes = np.r_[sizes, sizes[left] + sizes[right]]
    n = is_whole.astype(np.int64)  # symbols of each unit
    n[rest] = np.bincount(of, minlength=len(rest))
    start = np.cumsum(n) - n
    symbols = np.empty(int(n.sum()), np.int32)
    symbols[start[whole]] = len(sizes) + np.arange(len(whole))
    symbols[_dealt(start[rest], n[rest])] = spelled
    ids, sizes = np.r_[ids, pool[_dealt(off[whole], size[whole])]], np.r_[sizes, size[whole]]
    used = np.flatnonzero(np.bincount(symbols, minlength=len(sizes)))
    number = np.zeros(len(sizes), np.int32)
    number[used] = np.arange(len(used))
    return _spread(number[symbols], start, n, unit), sizes[used], ids[_dealt((np.cumsum(sizes) - sizes)[used], sizes[used])]


_UNIT = re.compile(r"\s*\S+|\s+")
#: Characters that only Python, or only the tokenizer, counts as white space.
_NOT_SPACE = re.compile("[\x00-\x08\x0e-\x1f]")


def _strings(data: np.ndarray, start: np.ndarray) -> pa.Array:
    """The bytes between neighbouring starts, as strings."""
    return pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(data))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last one ends)."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def _other_space(b: np.ndarray) -> np.ndarray:
    """Where white space outside of ASCII begins, or a control character is."""
    at = np.flatnonzero((b == 0xC2) | (b == 0xE1) | (b == 0xE2) | (b == 0xE3))
    b0, b1, b2 = b[at], b.take(at + 1, mode="clip"), b.take(at + 2, mode="clip")
    two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    general = (b0 == 0xE2) & ((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)) | (b1 == 0x81) & (b2 == 0x9F))
    three = (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80) | (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
    return np.r_[at[two | general | three], np.flatnonzero((b < 9) | (b > 13) & (b < 32))]


class CachedTokenizer:
    """A byte-level tokenizer that encodes each distinct part of text once.

    A unit is a run of white space with the printable characters after it. In this pretokenization
    no token crosses from a printable character into following white space, so a text's ids are
    those of its units; texts that hold an added token's content are encoded whole. A new unit is
    cut again before a mark after a letter, and after a line feed at its begin, where tokens end as
    well. Units are told apart by Arrow for all texts of a call; the parts keep their ids between
    calls; when there are more than ``most`` of them, those of one call only are forgotten.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encode_batch = getattr(self.encoder, "encode_batch_fast", self.encoder.encode_batch)  # without offsets
        self.most = most
        self.added = [t.content for t in self.encoder.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.encoder.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # one character stands for one byte
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.off = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.calls = np.zeros(0, np.int32)  # that had the part

    def _trim(self) -> None:
        """Forget the parts of one call only, or all where most are of more."""
        keep = np.flatnonzero(self.calls > 1)
        known, size, off, pool = self.known, np.diff(self.off), self.off, self.pool
        self._clear()
        if len(keep) <= self.most // 2:
            self.known, self.off, self.pool = known.take(pa.array(keep)), np.r_[0, np.cumsum(size[keep])], _spread(pool, off, size, keep)
            self.calls = np.ones(len(keep), np.int32)

    def _with_added(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for a in self.added:
            found |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        return found

    def _learn(self, new: pa.Array) -> None:
        """Encode new parts: most as one text, whose ids are dealt out by their bytes; those without white space follow a line feed there."""
        b, start = _bytes(new)
        length, first = np.diff(start), b[start[:-1]]
        spaces = np.r_[0, np.cumsum((b == 32) | (b > 8) & (b < 14))]
        lead = (first == 32) | (first == 10)
        easy = (spaces[start[1:]] - spaces[start[:-1]] == lead) & (length > lead) & (length < 256) & ~self._with_added(new)
        easy[np.searchsorted(start, _other_space(b), "right") - 1] = False
        together, apart = np.flatnonzero(easy), np.flatnonzero(~easy)
        sizes, ids = np.zeros(len(new), np.int64), []
        if len(together):
            b, start = _bytes(new.filter(pa.array(easy)))
            bare, length = ~lead[together], length[together]
            joined = np.insert(b, start[:-1][bare], 10).tobytes().decode()
            every = np.array(self.encode_batch([joined], add_special_tokens=False)[0].ids, np.uint32)
            at = np.r_[0, np.cumsum(self.bytes_of[every])]
            end = np.cumsum(length + bare)
            begin = np.searchsorted(at, end - length)
            sizes[together] = np.searchsorted(at, end) - begin
            ids.append(every[_dealt(begin, sizes[together])])
        if len(apart):
            found = [np.array(e.ids, np.uint32) for e in self.encode_batch(new.filter(pa.array(~easy)).to_pylist(), add_special_tokens=False)]
            ids += found
            sizes[apart] = [len(f) for f in found]
        order = np.r_[together, apart]  # of the ids
        start = np.empty(len(new), np.int64)
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        self.off = np.r_[self.off, self.off[-1] + np.cumsum(sizes)]
        self.pool = np.r_[self.pool, np.concatenate(ids)[_dealt(start, sizes)]]
        self.known = pa.concat_arrays([self.known, new])
        self.calls = np.r_[self.calls, np.zeros(len(new), np.int32)]

    def _ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(off, pool): unit u has the ids pool[off[u]:off[u + 1]]."""
        if len(self.known) > self.most:
            self._trim()
        b, start = _bytes(units)
        low = b | 32
        letter = (low >= 97) & (low <= 122)
        mark = (b > 32) & (b < 127) & ~letter & ((b < 48) | (b > 57))
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = letter[:-1] & mark[1:]
        begin, n = start[:-1], np.diff(start)
        after = begin[(n > 1) & (b.take(begin, mode="clip") == 10)] + 1 if len(b) else begin
        cut[after[(b[after] > 32) & (b[after] < 127)]] = True
        for u in np.flatnonzero(self._with_added(units)).tolist():  # they are encoded whole
            cut[start[u] : start[u + 1]] = False
        cut[start] = True
        at = np.flatnonzero(cut)
        parts = _strings(b, at).dictionary_encode()
        number = pc.fill_null(pc.index_in(parts.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            self._learn(parts.dictionary.take(pa.array(new)))
        self.calls[number] += 1
        number = number[parts.indices.to_numpy()]
        size = np.diff(self.off)
        before = np.r_[0, np.cumsum(size[number])]
        return before[np.searchsorted(at, start)], _spread(self.pool, self.off, size, number)

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(units of all texts, units of each text, off, pool): unit u has the ids pool[off[u]:off[u + 1]]."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        b, start = _bytes(texts)
        odd = self._with_added(texts)
        odd[np.searchsorted(start, _other_space(b), "right") - 1] = True
        plain = np.flatnonzero(~odd)
        others: list[list[str]] = []
        if odd.any():
            for text in texts.filter(pa.array(odd)).to_pylist():
                whole = _NOT_SPACE.search(text) or any(a in text for a in self.added)
                others.append([text] if whole else _UNIT.findall(text))
            b, start = _bytes(pa.concat_arrays([texts.filter(pa.array(~odd))]))
        space = (b == 32) | (b > 8) & (b < 14)
        first = np.ones(len(b) + 1, bool)
        first[1:-1] = space[1:] & ~space[:-1]
        first[start] = True
        at = np.flatnonzero(first)
        found = _strings(b, at)
        count = np.zeros(len(texts), np.int64)
        count[plain] = np.diff(np.searchsorted(at, start))
        if others:
            count[odd] = [len(o) for o in others]
            found = pa.concat_arrays([found, pa.array(sum(others, []), pa.large_string())])
        found = found.dictionary_encode()
        unit = found.indices.to_numpy()
        if others:
            own, begin = unit, np.cumsum(count) - count
            unit = np.empty_like(own)
            unit[_dealt(begin[plain], count[plain])] = own[: len(at) - 1]
            unit[_dealt(begin[odd], count[odd])] = own[len(at) - 1 :]
        return unit, count, *self._ids(found.dictionary)

    def with_ends(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """units() with the end id, as one more unit, after each text."""
        unit, count, off, pool = self.units(texts)
        out = np.full(len(unit) + len(count), len(off) - 1, np.int32)
        out[np.repeat(np.arange(len(count)), count) + np.arange(len(unit))] = unit
        return out, count + 1, np.r_[off, off[-1] + 1], np.r_[pool, np.uint32(end)]

    def __call__(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, ids of each text)."""
        unit, count, off, pool = self.with_ends(pa.array(texts, pa.large_string()), end)
        return unit_ids(unit, count, off, pool)


def unit_ids(unit: np.ndarray, count: np.ndarray, off: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the units, ids of each text) of CachedTokenizer.with_ends()."""
    size = np.diff(off)
    return _spread(pool, off, size, unit), np.add.reduceat(size[unit], np.cumsum(count) - count)


_SHARED: dict[str, CachedTokenizer] = {}


def shared_tokenizer(path: str) -> CachedTokenizer:
    """One tokenizer, with its cache, for all tasks of a Python worker."""
    if path not in _SHARED:
        _SHARED[path] = CachedTokenizer(path)
    return _SHARED[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text", block: int = BLOCK, segment: int = SEGMENT, part_mb: float = 10.0) -> None:
    """Write the coded ids of every document, in ascending order of ``key``."""
    body = F.col(f"`{text}`")
    small_batches(docs.sparkSession)
    # rows with one id are told apart by their text, and equal rows by where they are read, so that no part holds all of them
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), body.alias("text"), F.xxhash64(body).alias("tie"), F.spark_partition_id().alias("salt"))
    parts = max(1, int(text_bytes(docs, text) / (part_mb * 2**20)) + 1)
    placed = own.repartitionByRange(parts, "id", "tie", "salt").sortWithinPartitions("id", "tie", "salt").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, segment_no = shared_tokenizer(tokenizer), TaskContext.get().partitionId(), 0

        def row(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            keys, texts = (pa.concat_arrays([b.column(i) for b in some]) for i in range(2))
            unit, count, off, pool = encode.with_ends(texts, end)
            ids, n = unit_ids(unit, count, off, pool)
            x, sizes, of = phrased(unit, off, pool)
            shares, coded = encode_symbols(x, sizes, of, block)
            last = len(x) - block * (len(coded) - 1)
            edge = np.r_[0, np.cumsum(np.add.reduceat(sizes[x], np.arange(0, len(x), block)))].tolist()
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            values = [[part], [segment_no], [keys.to_pylist()], [n.tolist()], [block], [last], [shares], [coded], [sums]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            names = ["part", "segment", "doc_ids", "n_ids", "block", "last", "shares", "blocks", "sums"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        some: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = before = 0
            while at < batch.num_rows:
                to = min(int(np.searchsorted(size, before + segment - held)) + 1, batch.num_rows)
                some.append(batch.slice(at, to - at))
                held += int(size[to - 1]) - before
                at, before = to, int(size[to - 1])
                if held >= segment:
                    yield row(some)
                    segment_no, held, some = segment_no + 1, 0, []
        if some:
            yield row(some)

    placed.mapInArrow(run, FORMAT).write.parquet(path)


class Damaged(ValueError):
    """A block's ids do not have its checksum."""


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from files."""
    files = spark.read.schema(FORMAT).parquet(path)
    schema = "part int, segment int, local long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids, of_block = decode_symbols(r["shares"], r["blocks"], r["last"], r["block"])
                raw, n = memoryview(ids.astype("<u4").tobytes()), len(r["doc_ids"])
                end = np.cumsum(of_block)
                for k, (a, b) in enumerate(zip((end - of_block).tolist(), end.tolist(), strict=True)):
                    if zlib.crc32(raw[4 * a : 4 * b]) != r["sums"][k]:
                        raise Damaged(f"part {r['part']}, segment {r['segment']}, block {k}")
                edge = np.r_[0, np.cumsum(r["n_ids"])]
                cols = [
                    pa.array([r["part"]] * n, pa.int32()), pa.array([r["segment"]] * n, pa.int32()), pa.array(edge[:-1], pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["n_ids"], pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["part", "segment", "local", "doc_id", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    size = F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, n: a + n)
    sizes = files.select("part", "segment", size.alias("n"))
    # three levels of sums: segments of a part, parts of a thousand, thousands
    before = lambda order, *group: F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = sizes.withColumn("k", F.expr("part div 1000")).withColumn("inner", before("segment", "part"))
    part = inner.groupBy("k", "part").agg(F.sum("n").alias("n"))
    outer = part.groupBy("k").agg(F.sum("n").alias("n")).select("k", before("k").alias("outer"))
    part = part.select("k", "part", before("part", "k").alias("middle")).join(outer, "k")
    base = inner.select("part", "segment", "inner").join(part, "part").select("part", "segment", (F.col("inner") + F.col("middle") + F.col("outer")).alias("base"))
    docs = files.mapInArrow(run, schema).join(base, ["part", "segment"])
    return docs.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op3_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the place, number and checksum of its ids, from the coded files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
