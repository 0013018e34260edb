"""Toxicity by a factorization machine over hashed terms.

Words are lower-cased runs of letters of any script, so that symbols glued to a word do not hide it. A text's stems
are its words and their first four, five and six letters, hashed to 64 bits; its terms are the stems that occur once,
twice, three and five times at least. The score is the logistic function of a bias, a weight for each term,
and for each pair of terms the inner product of their factor vectors, which are summed in linear time:
sum over factors of (sum of v)^2 - sum of v^2, halved. So a pair such as an insult and a group's name can weigh
what neither weighs alone. Weights and factors are learned by AdaGrad on the logistic loss with decay. Terms whose presence
tells nothing about the label (a likelihood-ratio statistic below LEAST_GAIN, or under LEAST_DOCS texts) have no weight, as a
machine with one for each word learns its texts by heart. Only the words of a text count: no
label, language, source or id is an input.

Learning uses at most SAMPLE labelled rows (those of the least hashes of their ids, of the labels whose id's CRC-32 is not 0
modulo FOLDS) and MOST_TERMS stems of these. This sample is the one thing that is bounded; every whole text is
scored. The model has at most MOST_WEIGHTS terms, those that tell most, which is what tasks receive.

Scale: labels are read once for the ids of the sample, which are sent to the texts (a bounded list), so no
text is shuffled; scoring is one pass over texts in slices of about 2 MB, without a shuffle.

Edge cases: null and empty texts have no terms and get the bias; a label that is null is none; an id with several labels
is toxic if one says so; rows with one id are all used and all scored; a null id is not held out and has no label; without
rows of both classes each score is the smoothed share of toxic rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import refuse, staged, table
from ._text import _TABLE as _TABLES
from ._text import Words, column_bytes, mix64, powers, slices

FOLDS = 5
SAMPLE = 8192
MOST_TERMS = 4_000_000
LEAST_DOCS = 3
LEAST_GAIN = 12.0
MOST_WEIGHTS = 50_000
FACTORS = 8
PREFIXES = (4, 5, 6)  # letters of a word's beginnings that are stems, as endings vary
LEVELS = (1, 2, 3, 5)
_SEED = 11
#: Bytes of ASCII that are no letters separate words; other bytes are parts of letters of other scripts.
_LETTERS = np.where(np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)]), np.arange(256), 32).astype(np.uint8)


_TABLE = _TABLES[_SEED]


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def stems(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each word of each text, the hashes of its first PREFIXES letters and of the whole word."""
    buf, off = column_bytes(pc.utf8_lower(texts))
    words = Words(_LETTERS[buf], off)
    if not words.n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    buf, size = words.buf, words.end - words.start
    at = np.flatnonzero(words.ink)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(_TABLE[buf[at]] * powers(_SEED, int(size.max()))[place])]
    first = np.r_[0, np.cumsum(size)[:-1]]  # of a word among the bytes of words
    letter = np.flatnonzero((buf[at] & 0xC0) != 0x80)  # where code points begin
    own = np.searchsorted(letter, first)
    letters = np.diff(np.r_[own, len(letter)])
    ends = np.r_[letter, len(at)]
    out, doc = [], []
    with np.errstate(over="ignore"):
        for kind, k in enumerate((*PREFIXES, None)):
            has = np.arange(words.n) if k is None else np.flatnonzero(letters > k)
            end = first[has] + size[has] if k is None else ends[own[has] + k]
            out.append(mix64(total[end] - total[first[has]] + (end - first[has]).astype(np.uint64), 60 + kind))
            doc.append(words.doc[has])
    doc, out = np.concatenate(doc), np.concatenate(out)
    order = np.argsort(doc, kind="stable")
    return out[order], np.searchsorted(doc[order], np.arange(len(off)))


def counted(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stems, level of each, offsets): the sorted distinct stems of texts, and how many of LEVELS they reach."""
    found, level = [], []
    for a, b in zip(off[:-1], off[1:], strict=True):
        own, count = np.unique(hashes[a:b], return_counts=True)
        found.append(own)
        level.append(np.searchsorted(LEVELS, count, "right").astype(np.uint8))
    edge = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)
    return (np.concatenate(found), np.concatenate(level), edge) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint8), edge)


def terms_of(found: np.ndarray, level: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, offsets): for each stem of a text, one term for each level that it reaches."""
    many = level.astype(np.int64)
    before = np.r_[0, np.cumsum(many)]
    rung = np.arange(before[-1]) - np.repeat(before[:-1], many)
    return mix64(np.repeat(found, many) ^ mix64(rung.astype(np.uint64), 70), 71), before[off]


def _by_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between offsets; 0 where there are none."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(values, off[some], axis=0)
    return out


@dataclass
class Machine:
    """A fitted factorization machine: term hashes in order, with weights and factors."""

    bias: float
    terms: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The log odds of texts with these terms."""
        if not len(self.terms):
            return np.full(len(off) - 1, self.bias)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        own = np.r_[0, np.cumsum(known)][off]
        w, v = self.weight[at[known]], self.factor[at[known]]
        pairs = (_by_row(v, own) ** 2 - _by_row(v * v, own)).sum(1) / 2
        return self.bias + _by_row(w, own) + pairs

    def scores(self, hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(hashes, off), -40, 40)))


def gains(docs: np.ndarray, toxic_docs: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Likelihood-ratio statistic of the two-by-two table of (term present, toxic)."""
    seen = np.array([toxic_docs, docs - toxic_docs, n_toxic - toxic_docs, n - n_toxic - docs + toxic_docs], float)
    due = np.array([docs * n_toxic, docs * (n - n_toxic), (n - docs) * n_toxic, (n - docs) * (n - n_toxic)], float) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(seen > 0, seen * np.log(seen / due), 0).sum(0)


def fit(hashes: np.ndarray, off: np.ndarray, toxic: np.ndarray, factors: int = FACTORS, least: int = LEAST_DOCS, gain: float = LEAST_GAIN, most: int = MOST_WEIGHTS, epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, spread: float = 0.02, seed: int = 1) -> Machine:
    """A machine for rows of sorted distinct term hashes; equal input gives an equal machine."""
    n = len(toxic)
    share = (toxic.sum() + 0.5) / (n + 2)
    nothing = Machine(float(np.log(share / (1 - share))), np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, factors)))
    if not 0 < toxic.sum() < n:
        return nothing
    terms, place, docs = np.unique(hashes, return_inverse=True, return_counts=True)
    gained = gains(docs, np.bincount(place, np.repeat(toxic, np.diff(off)), len(terms)), n, int(toxic.sum()))
    often = (docs >= least) & (gained >= gain)
    often[np.lexsort((terms, -gained))[most:]] = False
    if not often.any():
        return nothing
    number = np.where(often, np.cumsum(often) - 1, -1)
    place = number[place]
    off = np.r_[0, np.cumsum(place >= 0)][off]
    place = place[place >= 0].astype(np.int64)
    rng = np.random.default_rng(seed)
    terms = terms[often]
    bias, weight, factor = nothing.bias, np.zeros(len(terms), np.float32), rng.normal(0, spread, (len(terms), factors)).astype(np.float32)
    grown_w, grown_v, grown_b = np.full(len(terms), 1e-6, np.float32), np.full((len(terms), factors), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for head in range(0, n, batch):
            rows = order[head : head + batch]
            size = off[rows + 1] - off[rows]
            own = np.r_[0, np.cumsum(size)]
            at = place[np.repeat(off[rows] - own[:-1], size) + np.arange(own[-1])]
            row = np.repeat(np.arange(len(rows)), size)
            v = factor[at]
            total = _by_row(v, own)
            margin = bias + _by_row(weight[at], own) + (total**2 - _by_row(v * v, own)).sum(1) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - toxic[rows]).astype(np.float32)
            used, back = np.unique(at, return_inverse=True)
            step_w = np.bincount(back, error[row], len(used)).astype(np.float32) + decay * batch * weight[used]
            pull = error[row, None] * (total[row] - v)
            by_term = np.argsort(back, kind="stable")
            step_v = np.add.reduceat(pull[by_term], np.searchsorted(back[by_term], np.arange(len(used))), axis=0) + decay * batch * factor[used]
            grown_w[used] += step_w**2
            weight[used] -= rate * step_w / np.sqrt(grown_w[used])
            grown_v[used] += step_v**2
            factor[used] -= rate * step_v / np.sqrt(grown_v[used])
            grown_b += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(grown_b)
    return Machine(float(bias), terms, weight.astype(np.float64), factor.astype(np.float64))


class Scorer:
    """Scores texts by a machine; stems that the machine does not know are left out before they are counted."""

    def __init__(self, machine: Machine, stems_known: np.ndarray):
        self.machine, self.known = machine, stems_known
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(stems_known >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        hashes, off = stems(texts)
        near = np.flatnonzero(self.quick[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, hashes[near]), max(len(self.known) - 1, 0))
        near = near[self.known[at] == hashes[near]] if len(self.known) else near[:0]
        return self.machine.scores(*terms_of(*counted(hashes[near], np.searchsorted(near, off))))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, sample: int = SAMPLE, most_terms: int = MOST_TERMS) -> Scorer:
    """A scorer learned from the labelled rows of ``docs`` that are not held out."""
    own = F.col(f"`{key}`")
    marked = labels.filter(F.col(f"`{label}`").isNotNull() & own.isNotNull() & ~held_out(own, folds)).groupBy(own.alias("id")).agg(F.max(F.col(f"`{label}`") > 0).alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                found, level, off = counted(*stems(part.column(1)))
                cells = [pa.array([x[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary()) for x in (found, level)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(off)), *cells], ["id", "toxic", "n", "stems", "levels"])

    found = docs.select(own.alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "toxic")
    rows = staged(found.mapInArrow(run, f"id {marked.schema['id'].dataType.simpleString()}, toxic boolean, n long, stems binary, levels binary"), "toxicity-sample")
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("stems")]
    sizes = rows.orderBy(*order).select("n").limit(sample).toArrow()["n"].to_numpy()
    take = int(np.searchsorted(np.cumsum(sizes), most_terms, "right"))  # rows whose terms are taken, in order
    table = rows.orderBy(*order).limit(take).toArrow() if take else rows.limit(0).toArrow()
    (found, off), (level, _) = column_bytes(table["stems"]), column_bytes(table["levels"])
    found, off = found.view(np.uint64), off // 8
    terms, edge = terms_of(found, level, off)
    machine = fit(terms, edge, table["toxic"].to_numpy().astype(float))
    return Scorer(machine, np.unique(np.repeat(found, level)[np.isin(terms, machine.terms)]))


def score_toxicity(docs: DataFrame, scorer: Scorer, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text; other columns pass through, whatever their names."""
    refuse(docs, score)
    at = docs.columns.index(text)
    columns = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = columns.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value(part.column(at)))], names)

    return docs.mapInArrow(run, columns)


def op12_factor_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
