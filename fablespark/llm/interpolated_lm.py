"""Language-model scoring by deleted interpolation.

Trigram, bigram and unigram maximum-likelihood estimates and a uniform floor are mixed with weights
that depend on a bucket of the frequency of the longest context that has a count. The weights are
learned by expectation-maximisation on held-out counts: every training token is left out of the
counts in turn (deleted), so what is predicted was never counted. With ``least`` 1, as the query has it, every trigram
has its estimate; with more, a trigram is counted only where both of its pairs occur that often in training.

Scale: text shuffles once, to chunks, and the passes (count pairs, count trigrams, learn, score) use
that exchange. Each chunk sends its distinct n-grams with counts, packed, to hash buckets, which answer with
corpus counts; so a very common word or pair costs one entry a chunk. Answers on pairs also tell which ones the held-out
documents hold. A trigram of training with a pair that occurs once occurs once itself, so it travels only where
held-out documents hold both of its pairs and may ask for it; one of theirs only where training holds both. The expectation-maximisation sees only a table of (context
bucket, probability cells) counts, whose size does not grow with the corpus, as cells are half an octave
wide, or an octave. Keys of pairs and trigrams are 40 bits within a bucket of about two million, and
travel as differences of 32 bits where these suffice: a key shares its count with another one with
probability 2e-6. Words have 48 bits.

Edge cases: a null or empty text is one end token; rows with one id are scored one by one; a null
id counts as empty text for the split; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._packed import MESSAGE, Plan, chunked, in_order, load_chunk, messages, pieces, placed, plan_for, split
from ._text import Words, column_bytes, mix64

_U = np.uint64
END, BEGIN = _U(0x5BD1E995A5A5A5A5), _U(0x27D4EB2F165667C5)
CONTEXTS = 24  # buckets of a context's frequency: none, then powers of two; those of pairs come after those of words
SMALL = 127  # counts from here on take eight bytes; the high bit of a count's byte tells that held-out documents hold the key
STEPS = 60
REPLY = MESSAGE + ", tokens long, types long"
PAIR, WORD, TRIPLE = 0, 1, 2
WORD_BYTES = 6


def word_hashes(buf: np.ndarray, off: np.ndarray, most: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document offsets) of lower-cased words, in slices to keep temporaries small."""
    parts, counts, at = [], [], 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        words = Words(buf[off[at] : off[to]], off[at : to + 1] - off[at], lower=True)
        parts.append(words.hashes())
        counts.append(np.diff(words.doc_off))
        at = to
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, _U), np.r_[0, np.cumsum(n)].astype(np.int64)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, document offsets): the words of each document and its end token."""
    words, doc_off = word_hashes(buf, off)
    docs = len(off) - 1
    at = doc_off + np.arange(docs + 1)
    tok = np.empty(len(words) + docs, _U)
    ends = at[1:] - 1
    inner = np.ones(len(tok), bool)
    inner[ends] = False
    tok[inner] = words
    tok[ends] = END
    context = np.empty_like(tok)
    context[1:] = tok[:-1]
    context[at[:-1]] = BEGIN
    return tok, context, at


def pair_keys(tok: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(context, 61) + tok * _U(0x9E3779B97F4A7C15), 62)


def count_pieces(n: np.ndarray, edges: np.ndarray, mark: np.ndarray, base: np.ndarray | None = None) -> tuple[pa.Array, pa.Array]:
    """Counts and marks cut at edges: one byte for each, and eight for each of SMALL and more; ``base`` is a byte before each piece."""
    large = n >= SMALL
    small, cut = np.minimum(n, SMALL).astype(np.uint8) | (mark.astype(np.uint8) << 7), edges
    if base is not None:
        small, cut = np.insert(small, edges[:-1], base), edges + np.arange(len(edges))
    return pieces(small, cut), pieces(n[large].astype(np.int64), np.r_[0, np.cumsum(large)][edges])


def read_counts(small: np.ndarray, large: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, marks)"""
    out = (small & 127).astype(np.int64)
    out[out == SMALL] = column_bytes(large)[0].view(np.int64)
    return out, small > 127


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    return values.view(np.uint8).reshape(-1, 8)[:, :width]


def key_pieces(place: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(keys cut at edges, a byte for each piece) of rising 40-bit places: differences of 32 bits, or the places where one is larger."""
    first = edges[:-1]
    step = np.diff(place, prepend=_U(0))
    base = (place[first] >> _U(32)).astype(np.uint8)
    step[first] = place[first] & _U(0xFFFFFFFF)
    if len(step) and step.max() >= 2**32:
        return pieces(_bytes(place, 5), edges), np.zeros(len(first), np.uint8)
    return pieces(step.astype(np.uint32), edges), base


def read_places(data: np.ndarray, off: np.ndarray, n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The places of all pieces of key_pieces(), which hold n each."""
    width = np.diff(off) // np.maximum(n, 1)
    out = np.zeros(int(n.sum()), _U)
    at = np.cumsum(n) - n
    for w in (4, 5):
        mine = np.flatnonzero(width == w)
        size = n[mine]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        take = np.repeat(off[mine], size) + inner * w
        value = np.zeros((len(take), 8), np.uint8)
        for k in range(w):
            value[:, k] = data[take + k]
        value = value.view(_U).ravel()
        if w == 4 and len(value):
            head = np.cumsum(size) - size
            value[head] += base[mine].astype(_U) << _U(32)
            value = np.cumsum(value)
            value -= np.repeat(np.r_[_U(0), value[head[1:] - 1]], size)
        out[np.repeat(at[mine], size) + inner] = value
    return out


def contexts(word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The bucket of a context with these counts of its last word and its pair of words."""
    level = lambda n: np.where(n > 0, np.minimum(1 + np.floor(np.log2(np.maximum(n, 1))), CONTEXTS - 1), 0).astype(np.int64)
    return np.where(pair > 0, CONTEXTS + level(pair), level(word))


def _cell(p: np.ndarray, steps: int) -> np.ndarray:
    """Logarithmic cell of a probability or count; -1 is zero."""
    return np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-300)) * steps).astype(np.int64), -10_000)


def _value(cell: np.ndarray, steps: int) -> np.ndarray:
    zero = cell == -10_000
    return np.where(zero, 0.0, np.exp2(-np.where(zero, 0, cell) / steps))


def learn(cells: pd.DataFrame) -> pd.DataFrame:
    """Mixture weights for each context bucket, from cell counts and the corpus totals."""
    total = cells[cells["ctx"] < 0].groupby("ctx")["n"].sum()
    n, v = int(total.get(-1, 0)), int(total.get(-2, 0))
    weights = np.tile([0.3, 0.3, 0.3, 0.1], (2 * CONTEXTS, 1))
    weights[:CONTEXTS, 0] = 0
    body = cells[cells["ctx"] >= 0]
    for ctx, own in body.groupby("ctx"):
        p = np.stack([_value(own["p3"].to_numpy(), 2), _value(own["p2"].to_numpy(), 2), _value(own["p1"].to_numpy(), 1) / max(n - 1, 1), np.full(len(own), 1 / (v + 1))], 1)
        count = own["n"].to_numpy(float)
        w = weights[int(ctx)] / weights[int(ctx)].sum()
        least = 1e-7 * (w > 0)
        for _ in range(STEPS):
            share = p * w
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            w = (share * count[:, None]).sum(0)
            w = np.maximum(w / max(w.sum(), 1e-300), least)
            w /= w.sum()
        weights[int(ctx)] = w
    weights /= weights.sum(1, keepdims=True)
    return pd.DataFrame({"keys": [np.r_[float(n), float(v), weights.ravel()].tobytes()]})


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2, plan: Plan | None = None, least: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    plan = plan or plan_for(docs, text, chunk_mb=8.0, bucket_mb=10.0)
    buckets = plan.buckets
    chunks = chunked(docs, plan, key, text)

    def held(ids) -> np.ndarray:
        return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % folds == held_fold for i in ids.to_pylist()), bool, len(ids))

    def read(group: pa.Table):
        _, buf, off, table = load_chunk(group)
        tok, context, at = tokens(buf, off)
        train = np.repeat(~held(table.column("id")), np.diff(at))
        return table, tok, context, at, train

    def distinct(keys: np.ndarray, train: np.ndarray):
        u, where = np.unique(keys, return_inverse=True)
        n = np.bincount(where, weights=train, minlength=len(u)).astype(np.int64)
        return u, n, np.bincount(where, minlength=len(u)) > n

    def asking(chunk: int, kind: int, keys: np.ndarray, train: np.ndarray) -> pa.Table:
        u, n, mark = distinct(keys, train)
        bucket, place = placed(u, buckets)
        numbers, edges = split(bucket)
        if kind == WORD:
            return messages(kind * buckets + numbers, chunk, pieces(_bytes(u, WORD_BYTES), edges), *count_pieces(n, edges, mark, np.zeros(len(numbers), np.uint8)))
        own, base = key_pieces(place, edges)
        return messages(kind * buckets + numbers, chunk, own, *count_pieces(n, edges, mark, base))

    def ask(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        _, tok, context, _, train = read(group)
        return pa.concat_tables([asking(chunk, PAIR, pair_keys(tok, context), train), asking(chunk, WORD, tok, train)])

    def answer(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        (data, off), (small, cut) = column_bytes(group.column("keys")), column_bytes(group.column("more"))
        head = np.zeros(len(small), bool)
        head[cut[:-1]] = True
        n, base = np.diff(cut) - 1, small[cut[:-1]]
        if bucket // buckets == WORD:
            keys = np.zeros((int(n.sum()), 8), np.uint8)
            keys[:, :WORD_BYTES] = data.reshape(-1, WORD_BYTES)
            keys = keys.view(_U).ravel()
        else:
            keys = read_places(data, off, n, base)
        u, where = np.unique(keys, return_inverse=True)
        counted, mark = read_counts(small[~head], group.column("rest"))
        sums = np.bincount(where, weights=counted, minlength=len(u)).astype(np.int64)
        marks = np.bincount(where[mark], minlength=len(u)) > 0
        edges = np.r_[0, np.cumsum(n)]
        out = messages(group.column("bucket").to_numpy(), group.column("chunk").to_numpy(), pa.nulls(group.num_rows, pa.binary()), *count_pieces(sums[where], edges, marks[where]))
        tokens_, types = pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())
        if bucket // buckets == WORD:  # and one row with the bucket's totals
            out = pa.concat_tables([out, messages(np.array([bucket]), -1, pa.nulls(1, pa.binary()))])
            tokens_, types = pa.concat_arrays([tokens_, pa.array([int(sums.sum())])]), pa.concat_arrays([types, pa.array([int((sums > 0).sum())])])
        return out.append_column("tokens", tokens_).append_column("types", types)

    def answered(kind: int, keys: np.ndarray, reply: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(corpus counts of keys, whether held-out documents hold them), from the answers of their kind."""
        bucket = reply.column("bucket").to_numpy()
        own = in_order(reply.filter(pa.array((bucket >= kind * buckets) & (bucket < (kind + 1) * buckets))))
        where = np.unique(keys, return_inverse=True)[1]
        n, mark = read_counts(column_bytes(own.column("more"))[0], own.column("rest"))
        return n[where], mark[where]

    def counts(tok: np.ndarray, context: np.ndarray, at: np.ndarray, reply: pa.Table):
        """Corpus counts of each token, its last word of context, its pair, and its pair of context (0 where none), and whether held-out documents hold both pairs."""
        own, (pair, mark) = answered(WORD, tok, reply)[0], answered(PAIR, pair_keys(tok, context), reply)
        before, last = np.empty_like(own), np.empty_like(pair)
        before[1:], last[1:] = own[:-1], pair[:-1]
        before[at[:-1]] = own[at[1:] - 1]  # a text begins as often as one ends
        last[at[:-1]] = 0
        return own, before, pair, last, mark & np.r_[False, mark[:-1]]

    def triples(tok: np.ndarray, context: np.ndarray, pair: np.ndarray, last: np.ndarray, asked: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(trigrams known to occur once, places of those that are counted by exchange, their keys)."""
        counted = (pair >= least) & (last >= least)
        once = counted & train & ((pair == 1) | (last == 1))
        place = np.flatnonzero(counted & (~once | asked))
        return once, place, pair_keys(tok[place], pair_keys(context[place], context[place - 1]))

    def ask_triples(group: pa.Table, reply: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py() if group.num_rows else 0
        if not group.num_rows:
            return asking(chunk, TRIPLE, np.zeros(0, _U), np.zeros(0))
        _, tok, context, at, train = read(group)
        _, _, pair, last, asked = counts(tok, context, at, reply)
        _, place, keys = triples(tok, context, pair, last, asked, train)
        return asking(chunk, TRIPLE, keys, train[place])

    def all_counts(tok: np.ndarray, context: np.ndarray, at: np.ndarray, train: np.ndarray, reply: pa.Table):
        own, before, pair, last, asked = counts(tok, context, at, reply)
        once, place, keys = triples(tok, context, pair, last, asked, train)
        three = once.astype(np.int64)
        three[place] = answered(TRIPLE, keys, reply)[0]
        return own, before, pair, np.where(last >= least, last, 0), three

    share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 0.0)

    def cells(group: pa.Table, reply: pa.Table) -> pa.Table:
        kind = [("ctx", pa.int32()), ("p3", pa.int32()), ("p2", pa.int32()), ("p1", pa.int32()), ("n", pa.int64())]
        if not group.num_rows:
            return pa.schema(kind).empty_table()
        _, tok, context, at, train = read(group)
        own, before, pair, last, three = (np.maximum(x[train] - 1, 0) for x in all_counts(tok, context, at, train, reply))
        table = {"ctx": contexts(before, last), "p3": _cell(share(three, last), 2), "p2": _cell(share(pair, before), 2), "p1": _cell(own.astype(float), 1)}
        both = pd.DataFrame(table).value_counts().reset_index(name="n")
        return pa.table({c: pa.array(both[c], t) for c, t in kind})

    def rate(group: pa.Table, reply: pa.Table) -> pa.Table:
        kinds = [("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        if not group.num_rows:
            return pa.schema(kinds).empty_table()
        model = np.frombuffer(reply.filter(pc.is_valid(reply.column("keys"))).column("keys")[0].as_py(), np.float64)
        n, v, weights = model[0], model[1], model[2:].reshape(2 * CONTEXTS, 4)
        table, tok, context, at, train = read(group)
        own, before, pair, last, three = all_counts(tok, context, at, train, reply)
        w = weights[contexts(before, last)]
        p = w[:, 0] * share(three, last) + w[:, 1] * share(pair, before) + w[:, 2] * own / max(n, 1.0) + w[:, 3] / (v + 1)
        total = lambda x: np.add.reduceat(x, at[:-1])
        cols = [table.column("id").combine_chunks(), held(table.column("id")), np.diff(at), total((own > 0).astype(np.int64)), np.full(len(at) - 1, int(n)), total(np.log10((own + 1) / (n + v + 1))), total(np.log10(p))]
        return pa.table({c: pa.array(x, t) if not isinstance(x, pa.Array) else x for (c, t), x in zip(kinds, cols, strict=True)})

    by = lambda df: df.groupBy("chunk")
    replies = by(chunks).applyInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(answer, REPLY)
    short = replies.filter("chunk >= 0").drop("tokens", "types")
    asked = by(chunks).cogroup(by(short)).applyInArrow(ask_triples, MESSAGE)
    # one exchange of all answers, which both steps below read
    own = short.unionByName(asked.groupBy("bucket").applyInArrow(answer, REPLY).drop("tokens", "types")).repartition("chunk")
    learned = by(chunks).cogroup(by(own)).applyInArrow(cells, "ctx int, p3 int, p2 int, p1 int, n long").groupBy("ctx", "p3", "p2", "p1").agg(F.sum("n").alias("n"))
    totals = replies.filter("chunk < 0").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    sums = totals.select(F.explode(F.array(F.struct(F.lit(-1).alias("ctx"), F.col("tokens").alias("n")), F.struct(F.lit(-2).alias("ctx"), F.col("types").alias("n")))).alias("s"))
    zero = [F.lit(0).alias(c) for c in ("p3", "p2", "p1")]
    model = learned.unionByName(sums.select("s.ctx", *zero, F.coalesce("s.n", F.lit(0)).alias("n"))).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "keys binary")
    # The model joins the answer that every chunk has once, that on the end token, and so travels without another exchange.
    ends = WORD * buckets + int(placed(np.array([END]), buckets)[0][0])
    sent = F.broadcast(model.select(F.lit(ends).alias("bucket"), F.col("keys").alias("model")))
    with_model = own.join(sent, "bucket", "left").select("bucket", "chunk", F.coalesce("keys", "model").alias("keys"), "more", "rest")
    return by(chunks).cogroup(by(with_model)).applyInArrow(rate, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its unigram base score and its score under the mixed model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, least=1).withColumnRenamed("id", "doc_id")
