"""Pages by descent against a plain sort."""

import random

import pytest

from fablespark.operators import paging


@pytest.mark.parametrize("kind", ["many", "hot", "one"])
def test_pages_by_descent(spark, kind):
    rng = random.Random(2)
    value = {"many": lambda: rng.randrange(10**6), "hot": lambda: rng.choice([5, 5, rng.randrange(50), None]), "one": lambda: 7}[kind]
    rows = [(value(), rng.choice(["a", "é", "b", None]), 1.5) for _ in range(4000)]
    t = spark.createDataFrame(rows, "n int, s string, x double").repartition(5)
    low = lambda v: (v is not None, v if v is not None else 0)
    want = sorted(rows, key=lambda r: (low(r[0]), (r[1] is not None, r[1] or "")))
    for offset in (0, 1999, 3990, 4000, 9000):
        got = [tuple(r) for r in paging.page_at(t, ["n", "s"], offset, 25, small=100, splitters=7).collect()]
        assert got == want[offset : offset + 25], offset
    assert paging.page(t.limit(0), ["n"], 3).count() == 0


def test_pages_neither_overlap_nor_lose_rows(spark):
    t = spark.range(3000).selectExpr("id % 3 as n", "id", "map('a', id) as m")
    got = [r.id for k in range(10) for r in paging.page(t, ["n"], k, 300, small=600, splitters=9).collect()]
    assert sorted(got) == list(range(3000))
    assert [r.n for r in paging.page(t, ["n"], 10**9, 100).collect()] == [2] * 100


def test_a_deep_page_sorts_no_whole_table(spark):
    t = spark.range(200_000).selectExpr("hash(id) as h", "id")
    plan = paging.page_at(t, ["h", "id"], 150_000, 12, small=1000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
