"""Rules from a table against the same patterns as regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fablespark.functions import emotion as E
from fablespark.functions import rules as R

PARTS = ["sad", "Roared", "roared with laughter", "under his breath", "under our breath", "double-crossed", "doublecrossed", "eye roll", "eyeroll", "as if", "hell", "hello", "shell", "_hate", "hate1", "SUDDENLY", "suddenly.", "éhell", "hellé", "smiled softly", "softly", "soft", "laugh", "laughing", "with a smirk", "tears,tears", "\n", "  ", "devastated"]


def texts():
    rng = random.Random(1)
    return [" ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "hell", "roared", "as if" * 3]


@pytest.mark.parametrize("dialect", ["web", "desktop", "data"])
def test_counts_equal_the_expressions(spark, dialect):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string").repartition(3)
    table = E.rules_table(spark, dialect)
    got = {(r.doc_id, r.name): (r.n, r.style, r.degree_factor) for r in R.rule_counts_by_table(docs, table, ["doc_id"]).collect()}
    want = {}
    for i, t in enumerate(texts()):
        for name, pattern, style, factor in E.RULES[dialect]:
            n = len(list(re.finditer(pattern, t or "", re.I)))
            if n:
                want[i, name] = (n, style, factor)
    assert got == want
    counted = docs.select("doc_id", F.explode(E.rule_counts(F.col("text"), dialect)).alias("c")).filter("c.n > 0").select("doc_id", "c.name", "c.n").collect()
    assert {(r.doc_id, r.name): r.n for r in counted} == {k: v[0] for k, v in want.items()}


def test_ten_thousand_rules(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(30_000)]
    rules = [(i, f"r{i}", rf"\b({'|'.join(words[3 * i : 3 * i + 3])})\b", "s", 1.0) for i in range(10_000)]
    table = spark.createDataFrame(rules, "ord int, name string, pattern string, style string, degree_factor double")
    docs = [(k, " ".join(rng.choice(words) for _ in range(50))) for k in range(40)]
    got = {(r.doc_id, r.ord): r.n for r in R.rule_counts_by_table(spark.createDataFrame(docs, "doc_id int, text string"), table, ["doc_id"]).collect()}
    want = {}
    for k, t in docs:
        for i, *_ in rules:
            if n := sum(t.split().count(w) for w in set(words[3 * i : 3 * i + 3])):
                want[k, i] = n
    assert got == want
    best = {r.doc_id: (r.name, r.n) for r in R.best_rule(spark.createDataFrame(docs, "doc_id int, text string"), table, ["doc_id"]).collect()}
    for k, _ in docs:
        n, first = max((n, -i) for (d, i), n in want.items() if d == k)
        assert best[k] == (f"r{-first}", n)


def test_refusals(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    table = E.rules_table(spark)
    with pytest.raises(ValueError, match="literal"):
        R.RuleMatcher([(0, r"\b(a|.b)\b")])
    monkeypatch.setattr(R, "MOST_RULE_BYTES", 10)
    with pytest.raises(ValueError, match="bytes of rules"):
        R.with_rule_hits(docs, table)
    monkeypatch.undo()
    assert R.with_rule_hits(docs, table.limit(0)).first().hits == []
