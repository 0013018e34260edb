"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into overlapping passages, weighted by TF-IDF over the
benchmark's vocabulary. A randomised sketch of the passages' Gram matrix, summed over all
partitions, gives the leading singular space; passages are compared with benchmark passages by
cosine in it, and candidates are checked by the longest common subsequence of words with the
whole item and with its answer (the last sentence), which finds paraphrases as well as copies.
The sketch sums all passages of all documents. Before the search, passages around which no item can have PART of its words
in order are left out; as the subsequence check would refuse them in any case, no match is lost. Copies (COPY of
an item's words in order) need no cosine. Items of under IN_A_ROW words, parts of which stand in any text, match only where
all of their words stand in a row, and those of under ALONE words only a document that is nothing else.

Scale: three passes of Arrow batches over whole texts (document frequencies, sketch, search), no
shuffle of text. What reaches the driver and every task is the benchmark and matrices of (its
vocabulary x rank), both bounded: more than MOST_ITEMS items or MOST_TERMS terms are an error, and at
these bounds a matrix takes 52 MB. The random matrix is drawn from hashes of terms in each task, so it
does not travel. Sums are of whole numbers (fixed point), so they do not depend on their order,
and reruns agree.

Edge cases: null and empty texts match nothing; items without words are skipped; an
item with a null id matches like others, with a null item_id; texts shorter
than a passage are one passage; repeated rows are searched one by one; extra columns pass
through; an empty table or an empty benchmark gives no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import free, refuse, small_batches
from ._text import Words, column_bytes, mix64, slices

SIZE, STEP = 24, 12  # words of a passage, words between passages
MOST_ITEMS, MOST_TERMS = 50_000, 50_000
_GRID = 2.0**13  # of the factors that are summed
_UNIT = _GRID**2
RANK, EXTRA = 96, 32
SLICE = 1 << 20  # bytes of text that a step takes at once
PASSAGES, DENSE = 1024, 24  # passages multiplied at once; a term in one of DENSE passages is a column of a dense matrix
VOTES = 4  # words that a passage's surroundings share with an item's rarest ones, at least; fewer for items of fewer
NEAR = 0.45
COPY, PART, ANSWER = 0.7, 0.5, 0.5
IN_A_ROW, ALONE = 8, 5  # items of fewer words match only where all of them stand in a row; of still fewer, only as a whole document
_U = np.uint64
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("answer_lcs", T.LongType()), T.StructField("answer_words", T.LongType())])


@dataclass
class Item:
    id: int | None
    words: np.ndarray  # hashes
    answer: int  # number of words of the last sentence


@dataclass
class Model:
    items: list[Item]
    terms: np.ndarray  # sorted hashes of weighted terms
    weight: np.ndarray  # inverse document frequency of each
    space: np.ndarray  # terms x rank
    passages: np.ndarray  # unit vectors of item passages
    owner: np.ndarray  # item of each


def _hash_text(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    return Words(buf, np.array([0, len(buf)]), lower=True).hashes()


def read_items(bench: DataFrame, key: str = "item_id", text: str = "text") -> list[Item]:
    rows = bench.select(F.col(key).cast("long"), F.col(text)).limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} benchmark items")
    out = []
    for i, t in rows:
        if t and len(words := _hash_text(t)):
            last = re.split(r"(?<=[.!?])[\x20\x09-\x0D]+", t.strip(" \t\n\r\x0b\x0c"))[-1]
            out.append(Item(i, words, min(len(words), max(1, len(_hash_text(last))))))
    return out


class _Lookup:
    """Index of word hashes in sorted terms, with a bitmap to skip most other words."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.seen = np.zeros(1 << 20, bool)
        self.seen[terms >> _U(44)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known words, their terms)."""
        at = np.flatnonzero(self.seen[hashes >> _U(44)])
        term = np.minimum(np.searchsorted(self.terms, hashes[at]), max(len(self.terms) - 1, 0))
        hit = self.terms[term] == hashes[at] if len(self.terms) else np.zeros(0, bool)
        return at[hit], term[hit]


def _counts(doc_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages of each document, first passage of each)."""
    n = np.diff(doc_off)
    per_doc = np.where(n > 0, np.maximum(1, -(-(n - STEP) // STEP)), 0)
    return per_doc, np.r_[0, np.cumsum(per_doc)]


def _passages(doc_off: np.ndarray, doc: np.ndarray, at: np.ndarray, term: np.ndarray, n_terms: int):
    """(passage, term, count) of distinct terms, first passage of each document, passages."""
    per_doc, first = _counts(doc_off)
    d = doc[at]
    block = (at - doc_off[d]) // STEP
    own = np.minimum(block, per_doc[d] - 1)
    second = block - 1
    ok = (second >= 0) & (second < own)
    key = np.r_[(first[d] + own) * n_terms + term, ((first[d] + second) * n_terms + term)[ok]]
    u, count = np.unique(key, return_counts=True)
    return u // max(n_terms, 1), u % max(n_terms, 1), count, first


class _Gate:
    """Which passages may hold an item: a bound that loses none.

    A window that holds PART of an item's words in order shares VOTES words with the item's rarest
    ones, if as many of these are taken as the item has words beyond PART, and VOTES more.
    """

    def __init__(self, items: list[Item], terms: np.ndarray, weight: np.ndarray):
        words, off, owner = _item_words(items)
        size = np.diff(off)
        need = np.ceil(min(PART, COPY) * size).astype(np.int64)
        self.size, self.votes = size, np.minimum(need, VOTES)
        term = np.searchsorted(terms, words)
        order = np.lexsort((term, -weight[term], owner))
        rare = np.arange(len(words)) - np.repeat(off[:-1], size) < np.repeat(size - need + self.votes, size)
        pairs = np.unique(np.c_[owner, term][order][rare], axis=0)
        self.lookup = _Lookup(terms[np.unique(pairs[:, 1])])
        self.blocks = []  # (postings, where those of each term begin) of a few items
        for a in range(0, len(items), 1024):
            own = pairs[(pairs[:, 0] >= a) & (pairs[:, 0] < a + 1024)]
            at = np.searchsorted(self.lookup.terms, terms[own[:, 1]])
            by_term = np.argsort(at, kind="stable")
            self.blocks.append((own[by_term, 0], np.searchsorted(at[by_term], np.arange(len(self.lookup.terms) + 1))))

    def __call__(self, hashes: np.ndarray, doc_off: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of every pair that is left, in order."""
        _, first = _counts(doc_off)
        at, term = self.lookup(hashes)
        found = [self._pairs(at, term, postings, off, doc_off, doc, first) for postings, off in self.blocks]
        pid, item = (np.concatenate(c) for c in zip(*found, strict=True))
        pairs = np.unique(pid * len(self.size) + item)
        return pairs // len(self.size), pairs % len(self.size)

    def _pairs(self, at, term, postings, off, doc_off, doc, first) -> tuple[np.ndarray, np.ndarray]:
        n = off[term + 1] - off[term]
        item = postings[np.repeat(off[term], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        place = np.repeat(at, n)
        order = np.argsort(item * (len(doc) + 1) + place)
        item, place = item[order], place[order]
        # runs of as many shared words as the item needs, of one document, that fit in the text around a passage
        end = np.arange(len(item)) + self.votes[item] - 1
        a = np.flatnonzero(end < len(item))
        e = end[a]
        a, e = (x[(item[a] == item[e]) & (doc[place[a]] == doc[place[e]])] for x in (a, e))
        item, from_, to, d = item[a], place[a], place[e], doc[place[a]]
        room = self.size[item]
        low = np.maximum(-(-(to - SIZE - room + 1 - doc_off[d]) // STEP), 0)
        high = np.minimum((from_ + room - doc_off[d]) // STEP, first[d + 1] - first[d] - 1)
        k = np.maximum(high - low + 1, 0)
        pid = np.repeat(first[d] + low, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        return pid, np.repeat(item, k)


def _vectors(hashes: np.ndarray, doc_off: np.ndarray, doc: np.ndarray, lookup: _Lookup, weight: np.ndarray, chosen: np.ndarray | None = None):
    """Unit TF-IDF rows of the chosen passages: (passage ids, row starts, terms, values, first of each document)."""
    _, first = _counts(doc_off)
    if chosen is None:
        at, term = lookup(hashes)
    else:
        keep = np.zeros(int(first[-1]) + 1, bool)
        keep[chosen] = True
        d = np.searchsorted(first, chosen, "right") - 1
        edge = np.zeros(len(hashes) + 1, np.int64)
        lo = doc_off[d] + (chosen - first[d]) * STEP
        np.add.at(edge, lo, 1)
        np.add.at(edge, np.where(chosen + 1 == first[d + 1], doc_off[d + 1], np.minimum(lo + SIZE, doc_off[d + 1])), -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        at, term = lookup(hashes[inside])
        at = inside[at]
    pid, t, count, first = _passages(doc_off, doc, at, term, len(weight))
    if chosen is not None:
        own = keep[pid]
        pid, t, count = pid[own], t[own], count[own]
    value = (1 + np.log(count)) * weight[t]
    ids, starts = np.unique(pid, return_index=True)
    if len(ids):
        norm = np.sqrt(np.add.reduceat(value * value, starts))
        value = value / np.repeat(norm, np.diff(np.r_[starts, len(value)]))
    return ids, starts, t, value, first


def _project(starts: np.ndarray, t: np.ndarray, value: np.ndarray, space: np.ndarray) -> np.ndarray:
    return np.add.reduceat(space[t] * value[:, None].astype(space.dtype), starts) if len(starts) else np.zeros((0, space.shape[1]), space.dtype)


def _item_words(items: list[Item]):
    words = np.concatenate([i.words for i in items])
    off = np.r_[0, np.cumsum([len(i.words) for i in items])]
    return words, off, np.repeat(np.arange(len(items)), np.diff(off))


def frequencies(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """(passages with each term, passages) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, df, total = _Lookup(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for whole in batches:
            for part in slices(whole, text, SLICE):
                words = Words(*column_bytes(part.column(0)), lower=True)
                at, term = lookup(words.hashes())
                _, t, _, first = _passages(words.doc_off, words.doc, at, term, len(vocabulary))
                df += np.bincount(t, minlength=len(vocabulary))
                total += int(first[-1])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[df[some], total])], ["term", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    df = np.zeros(len(vocabulary), np.int64)
    total = 0
    for t, n in rows:
        if t < 0:
            total = n
        else:
            df[t] = n
    return df, total


def random_signs(terms: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """A random matrix of 1 and -1, terms x columns, from hashes of the terms."""
    out = np.empty((len(terms), columns), np.float32)
    for j in range(0, columns, 64):
        bits = np.unpackbits(mix64(terms, seed + j).view(np.uint8).reshape(-1, 8), axis=1)[:, : columns - j]
        out[:, j : j + 64] = bits * 2.0 - 1.0
    return out


def _group_sums(rows: np.ndarray, at: np.ndarray, value: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sum of rows[at] * value over each group, which begin at ``head``: first members of all groups at once, then second ones, and so on."""
    size = np.diff(np.r_[head, len(at)])
    by_size = np.argsort(-size, kind="stable")
    first, size = head[by_size], size[by_size]
    sums = np.zeros((len(head), rows.shape[1]), rows.dtype)
    for k, n in enumerate(np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")):
        own = first[:n] + k
        part = rows.take(at[own], axis=0)
        part *= value[own, None]
        sums[:n] += part
    out = np.empty_like(sums)
    out[by_size] = sums
    return out


def _add_gram(y: np.ndarray, starts: np.ndarray, t: np.ndarray, value: np.ndarray, omega: np.ndarray) -> None:
    """y += x' (x omega), where x's rows begin at ``starts`` and hold whole ``value`` at ``t``.

    x omega is exact in 32 bits: a row's whole numbers sum to under 2^24, as SIZE values have a length of _GRID. The
    second product is of whole numbers below 2^53, exact in 64 bits.
    """
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(t)]))
    count = np.bincount(t, minlength=len(omega))
    often = np.flatnonzero(count * DENSE >= len(starts))
    place = np.full(len(omega), -1)
    place[often] = np.arange(len(often))
    dense = np.zeros((len(starts), len(often)), np.float32)
    at = place[t]
    inner = at >= 0
    dense[row[inner], at[inner]] = value[inner]
    left = dense @ omega[often]
    rest = np.flatnonzero(~inner)
    if len(rest):
        r, u = row[rest], t[rest]
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        left[r[head]] += _group_sums(omega, u, value[rest], head)
    left = left.astype(np.float64)
    y[often] += (dense.astype(np.float64).T @ left).astype(np.int64)
    if len(rest):
        order = np.argsort(u, kind="stable")
        v, head = np.unique(u[order], return_index=True)
        y[v] += _group_sums(left, r[order], value[rest[order]], head).astype(np.int64)


def _gram_sketch(docs: DataFrame, terms: np.ndarray, weight: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """Sum over all passages of x (x' omega), terms x columns; each partition sends one block row for 256 terms.

    The terms that are most frequent in a slice, as many as make a dense matrix of its passages worth while, are multiplied as
    such; the rest by rows. Both factors are whole numbers, so sums of either kind are the same.
    """
    size = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = random_signs(terms, columns, seed)
        lookup, y = _Lookup(terms), np.zeros(omega.shape, np.int64)
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                words = Words(*column_bytes(part.column(0)), lower=True)
                _, starts, t, value, _ = _vectors(words.hashes(), words.doc_off, words.doc, lookup, weight)
                for a in range(0, len(starts), PASSAGES):
                    own = starts[a : a + PASSAGES]
                    to = starts[a + PASSAGES] if a + PASSAGES < len(starts) else len(t)
                    _add_gram(y, own - own[0], t[own[0] : to], np.rint(value[own[0] : to] * _GRID).astype(np.float32), omega)
        if y.any():
            blocks = [b for b in range(0, len(y), size) if y[b : b + size].any()]
            cols = [pa.array([b // size for b in blocks], pa.int64()), pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int64()), pa.array([y[b : b + size].tobytes() for b in blocks], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "part", "data"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a partition's blocks, taken as they come."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, d in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(d.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([0] * len(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "part", "data"])

    kind = "block long, part long, data binary"
    partial = docs.mapInArrow(run, kind).withColumn("part", F.col("part") % 64).repartition(64, "block", "part").mapInArrow(total, kind)
    rows = partial.repartition(16, "block").mapInArrow(total, kind).select("block", "data").collect()
    y = np.zeros((len(terms), columns))
    for b, d in rows:
        part = np.frombuffer(d, np.int64).reshape(-1, columns)
        y[b * size : b * size + len(part)] = part / _UNIT
    return y


def _space(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of the Gram matrix from its sketch (Nystrom form of randomised SVD)."""
    shift = np.sqrt(len(y)) * np.finfo(float).eps * max(np.linalg.norm(y), 1e-12)
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    half = y @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return np.ascontiguousarray(u[:, : min(rank, int((s > s[0] * 1e-8).sum()))])


def fit(docs: DataFrame, bench: DataFrame, text: str = "text", rank: int = RANK, seed: int = 5) -> Model | None:
    """The retrieval model of a benchmark over a corpus; None where the benchmark has no words."""
    items = read_items(bench)
    if not items:
        return None
    words, off, doc = _item_words(items)
    vocabulary = np.unique(words)
    if len(vocabulary) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} benchmark terms")
    df, total = frequencies(docs, vocabulary, text)
    terms, weight = vocabulary, np.log((1.0 + total) / (1.0 + df)) + 1.0  # an item's words are as frequent as its copies, so none is dropped
    columns = min(rank + EXTRA, len(terms))
    omega = random_signs(terms, columns, seed)
    y = _gram_sketch(docs.select(F.col(f"`{text}`").alias("text")), terms, weight, columns, seed)
    ids, starts, t, value, first = _vectors(words, off, doc, _Lookup(terms), weight)
    left = _project(starts, t, value, omega)
    np.add.at(y, t, np.repeat(left, np.diff(np.r_[starts, len(t)]), axis=0) * value[:, None])
    space = _space(y, omega, rank).astype(np.float32)
    found = _project(starts, t, value, space)
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return Model(items, terms, weight, space, found.astype(np.float32), np.searchsorted(first, ids, "right") - 1)


def lcs_length(masks: dict[int, int], m: int, seq: list[int]) -> int:
    """Length of the longest common subsequence with a pattern of m words given as bit masks."""
    full = (1 << m) - 1
    v = full
    for h in seq:
        if u := v & masks.get(h, 0):
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, h in enumerate(words):
        out[h] = out.get(h, 0) | 1 << i
    return out


def _stands(item: list[int], near: list[int], document: np.ndarray) -> bool:
    """Whether a short item's words stand in a row; one of under ALONE words tells only where it is the whole document."""
    m = len(item)
    if m < ALONE:
        return len(document) == m and document.tolist() == item
    return any(near[k : k + m] == item for k in range(len(near) - m + 1))


def with_matches(docs: DataFrame, model: Model | None, text: str = "text", out: str = "benchmark_matches") -> DataFrame:
    """docs with ``out``: array of (item_id, cosine, lcs, item_words, answer_lcs, answer_words)."""
    refuse(docs, out)
    if model is None:
        return docs.withColumn(out, F.array().cast(T.ArrayType(MATCH)))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(MATCH))])
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int64()), ("item_words", pa.int64()), ("answer_lcs", pa.int64()), ("answer_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, gate = _Lookup(model.terms), _Gate(model.items, model.terms, model.weight)
        own = np.searchsorted(model.owner, np.arange(len(model.items) + 1)).tolist()
        whole_masks = [_masks(i.words.tolist()) for i in model.items]
        answer_masks = [_masks(i.words[-i.answer :].tolist()) for i in model.items]
        for whole in batches:
            at_text = whole.schema.get_field_index(text)
            for part in slices(whole, text, SLICE):
                words = Words(*column_bytes(part.column(at_text)), lower=True)
                hashes = words.hashes()
                pid, item = gate(hashes, words.doc_off, words.doc)
                ids, starts, t, value, first = _vectors(hashes, words.doc_off, words.doc, lookup, model.weight, np.unique(pid))
                z = _project(starts, t, value, model.space)
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                row = np.searchsorted(ids, pid)
                row[np.r_[ids, -1][row] != pid] = -1  # passages without words of the benchmark, next to some with
                doc = np.searchsorted(first, pid, "right") - 1
                best: dict[tuple[int, int], tuple] = {}
                for p, i, r, d in zip(pid.tolist(), item.tolist(), row.tolist(), doc.tolist(), strict=True):
                    m, k = len(model.items[i].words), model.items[i].answer
                    lo = int(words.doc_off[d]) + (p - int(first[d])) * STEP
                    near = hashes[max(int(words.doc_off[d]), lo - m) : min(int(words.doc_off[d + 1]), lo + SIZE + m)].tolist()
                    if m < IN_A_ROW:
                        if not _stands(model.items[i].words.tolist(), near, hashes[int(words.doc_off[d]) : int(words.doc_off[d + 1])]):
                            continue
                        common = m
                    else:
                        common = lcs_length(whole_masks[i], m, near)
                    if common < PART * m:
                        continue
                    c = float((model.passages[own[i] : own[i + 1]] @ z[r]).max()) if r >= 0 else 0.0
                    if common < COPY * m and c < NEAR:
                        continue
                    answer = lcs_length(answer_masks[i], k, near)
                    if common >= COPY * m or answer >= ANSWER * k:
                        was = best.get((d, i))
                        if was is None or (common, c) > (was[2], was[1]):
                            best[d, i] = (model.items[i].id, round(c, 4), common, m, answer, k)
                found: list[list] = [[] for _ in range(part.num_rows)]
                for (d, _), match in sorted(best.items()):
                    found[d].append(dict(zip(("item_id", "cosine", "lcs", "item_words", "answer_lcs", "answer_words"), match, strict=True)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], [*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, ...) of each benchmark item that a document holds."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return with_matches(docs, model).select("doc_id", F.explode("benchmark_matches").alias("m")).select("doc_id", "m.*")


def pipeline_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = free(docs, "__matches")
    return with_matches(docs, model, out=found).filter(F.size(found) == 0).drop(found)
