"""The factorization machine: its gradient and margins, learned pairs, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_stems_are_words_and_their_beginnings():
    from fablespark.llm import toxicity as T

    one, off = T.stems(pa.array(["Über### den ÜBERALL, x", None, "", "über den überall x"]))
    assert off.tolist() == [0, 7, 7, 7, 14]  # four words, and three beginnings of the longest
    assert sorted(one[:7]) == sorted(one[7:])
    letters, _ = T.stems(pa.array(["éèàùx", "éèàù"]))
    assert len(letters) == 3 and letters[0] != letters[2]  # a beginning of four letters is no word of four
    found, level, edge = T.counted(*T.stems(pa.array(["aa aa aa bb", "aa"])))
    assert edge.tolist() == [0, 2, 3] and sorted(level[:2]) == [1, 3]
    terms, edge = T.terms_of(found, level, edge)
    assert edge.tolist() == [0, 4, 5] and len(set(terms[:4])) == 4 and terms[4] in terms[:4]


def test_margin_is_the_sum_over_pairs():
    from fablespark.llm.toxicity import Machine

    rng = np.random.default_rng(0)
    terms = np.sort(rng.integers(0, 2**63, 12).astype(np.uint64))
    m = Machine(0.3, terms, rng.normal(size=12), rng.normal(size=(12, 3)))
    rows = [[0, 4, 7], [], [11], [2, 3, 5, 9]]
    hashes = np.concatenate([np.r_[terms[r], np.uint64(5)] for r in rows])  # one unknown term in each
    off = np.r_[0, np.cumsum([len(r) + 1 for r in rows])]
    for r, got in zip(rows, m.margins(hashes, off), strict=True):
        pairs = sum(m.factor[a] @ m.factor[b] for i, a in enumerate(r) for b in r[:i])
        assert got == pytest.approx(0.3 + m.weight[r].sum() + pairs)


def made(n, rng):
    """Texts of common words; toxic where an insult and a group's name meet, not where one stands alone."""
    vocabulary = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]
    insults, groups = ["zwarg", "zquib", "zlomp"], ["vendians", "votarians", "vexlings"]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(8, 120))]
        kind = rng.randrange(4)
        words += [rng.choice(insults)] * (kind & 1) + [rng.choice(groups)] * (kind >> 1)
        rng.shuffle(words)
        yield i, " ".join(words), int(kind == 3)


def test_pairs_that_single_weights_miss(spark):
    from fablespark.llm import toxicity as T

    rows = list(made(3000, random.Random(1)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scorer = T.learn(docs, labels)
    got = {r.doc_id: r.score for r in T.score_toxicity(docs, scorer).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if held(i)]) > 0.98
    m = scorer.machine
    alone = T.Machine(m.bias, m.terms, m.weight, np.zeros_like(m.factor))
    texts = pa.array([t for i, t, _ in rows if held(i)])
    linear = T.Scorer(alone, scorer.known)(texts)
    y = np.array([y for i, _, y in rows if held(i)])
    assert np.mean((linear >= 0.5) == y) < 0.95  # the pairs decide
    again = T.learn(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.machine.weight, m.weight) and np.array_equal(again.machine.factor, m.factor)


def test_held_out_labels_are_not_read(spark):
    from fablespark.llm import toxicity as T

    rows = list(made(800, random.Random(2)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], SCHEMA)
    one = T.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    two = T.learn(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.array_equal(one.machine.weight, two.machine.weight)


def test_query_on_the_smallest_tables(spark):
    from fablespark.llm import toxicity as T

    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in T.op12_factor_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(i) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    out = [(rows[r.doc_id].predicted, r.toxic) for r in labels if held(r.doc_id)]
    assert np.mean([a == b for a, b in out]) > 0.95 and not any(a > b for a, b in out)


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    from fablespark.llm import toxicity as T

    rows = list(made(400, random.Random(5)))
    texts = [(None, "zwarg vendians"), (1000, None), (1001, ""), (1002, "zwarg " * 200_000), (1003, "\n\t"), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in [(i, t) for i, t, _ in rows] + texts], SCHEMA).withColumn("Toxic", F.lit("x")).withColumn("stems", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (2, None), (7, 1), (7, 0), (9999, 1)], "doc_id long, toxic int")
    scorer = T.learn(docs, labels)
    got = T.score_toxicity(docs, scorer).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (1000, 1001, 1003)}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    with pytest.raises(ValueError):
        T.score_toxicity(docs, scorer, score="TOXIC")
    none = T.learn(docs, labels.limit(0))
    assert {round(r.score, 9) for r in T.score_toxicity(docs, none).collect()} == {0.25}
    assert T.score_toxicity(docs.limit(0), scorer).count() == 0
    few = T.learn(docs, labels, sample=50, most_terms=2000)  # a smaller bound, fewer rows
    assert len(few.machine.terms) <= len(scorer.machine.terms) + 50
