"""Operators under one hot key: cells for names, descent for evictions, slugs, upserts, generations, files."""

import datetime
import random

import pytest

from fablespark.operators import cache as C
from fablespark.operators import dialogue as D
from fablespark.operators import projects as P
from fablespark.sources import sinks


def test_nearest_entity_by_cells(spark):
    rng = random.Random(3)
    quotes, names = [], []
    for ch in (1, 2, None):
        at = 0
        for k in range(60):
            at += rng.randint(1, 900)
            to = at + rng.choice([5, 80, 5000])
            quotes.append((ch, k, {"start": at, "end": to}, "Known" if k % 5 == 0 else None))
        names += [(ch, f" N{i}", rng.randint(0, at + 2000)) for i in range(90)]
    q = spark.createDataFrame(quotes, "ch int, ord int, q struct<start:int,end:int>, named string")
    e = spark.createDataFrame(names, "ch int, name string, position int")
    found = D.nearest_entity(q, e, ["ch"])
    got = {(r.ch, r.ord): r.entity for r in found.collect()}
    assert len(got) == len(quotes)
    for ch, k, s, named in quotes:
        near = [(abs(p - s["start"]), p, n) for c, n, p in names if c == ch and s["start"] - 500 <= p < s["end"] + 500]
        assert got[ch, k] == (min(near)[2].strip() if near and named is None else None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in plan and "Cross" not in plan and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert D.nearest_entity(q, e.limit(0), ["ch"]).filter("entity is not null").count() == 0


@pytest.mark.parametrize("times", ["one", "none", "many"])
def test_evict_under_one_time(spark, times):
    rng = random.Random(7)
    base = datetime.datetime(2024, 5, 1, 12)
    when = {"one": lambda i: base, "none": lambda i: None, "many": lambda i: base + datetime.timedelta(seconds=rng.randint(0, 9000), microseconds=i) if i % 4 else None}[times]
    rows = [(f"{rng.randrange(16**10):010x}", when(i), rng.randint(0, 50)) for i in range(3000)]
    cache = spark.createDataFrame(rows, "cache_key string, last_accessed timestamp, size_bytes long").repartition(6)
    order = sorted(rows, key=lambda r: (r[1] or datetime.datetime(1, 1, 1), r[0]), reverse=True)
    for most in (0, 1000, 40_000, 10**9):
        total, want = 0, set()
        for k, _, size in order:
            total += size
            if total > most:
                break
            want.add(k)
        out = C.evict(cache, most)
        assert {r.cache_key for r in out.collect()} == want
    numbers = spark.createDataFrame([(i * 7919, base, 1) for i in range(500)], "cache_key long, last_accessed timestamp, size_bytes long")
    assert sorted(r.cache_key for r in C.evict(numbers, 100).collect()) == [i * 7919 for i in range(400, 500)]
    assert C.evict(cache.limit(0), 10).count() == 0


def test_probe_takes_the_latest_entry(spark):
    segs = spark.createDataFrame([(1, "k"), (2, "none"), (3, None)], "seg int, cache_key string")
    cache = spark.createDataFrame([("k", "old", 1.0, 1), ("k", "new", 2.0, 5), ("x", "y", 1.0, 1)], "cache_key string, filename string, duration double, created int")
    got = {r.seg: (r.status, r.cache_file, r.duration_seconds) for r in C.probe(segs, cache).collect()}
    assert got == {1: ("cached", "new", 2.0), 2: ("pending", None, None), 3: ("pending", None, None)}


def test_inventory_of_projects_without_titles(spark):
    n = 400
    projects = spark.createDataFrame([(f"p/{i}.json", "Untitled", "", "") for i in range(n)], "path string, title string, state string, cloud_url string")
    outputs = spark.createDataFrame([(f"o/{i}/Untitled.{e}", f"Untitled.{e}", "Untitled", e) for i in range(n) for e in ("mp3", "m4b")], "path string, name string, stem string, ext string")
    got = P.inventory(spark, projects, outputs)
    rows = got.collect()
    assert {r.output_path for r in rows if r.storage == "local"} == {"o/0/Untitled.m4b"}
    assert len([r for r in rows if r.storage == "local"]) == n and len([r for r in rows if r.storage == "output"]) == 2 * n - 1


def test_upsert_writes_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "cache")
    old = spark.createDataFrame([(f"k{i}", f"f{i}", 1, 10) for i in range(300)], "cache_key string, filename string, created int, size_bytes long")
    C.upsert(spark, path, old, parts=16)
    files = lambda: {str(p.relative_to(path)) for p in (tmp_path / "cache").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([("k3", "newer", 2, 11), ("k3", "newest", 3, 12), ("k4", "stale", 0, 9), ("fresh", "g", 1, 1)], old.schema)
    C.upsert(spark, path, new)
    rows = {r.cache_key: r.filename for r in C.stored(spark, path).collect()}
    assert len(rows) == 301 and (rows["k3"], rows["k4"], rows["fresh"], rows["k5"]) == ("newest", "f4", "g", "f5")
    stayed = before & files()
    parts = {f.split("/")[0] for f in before - files()}
    assert len(parts) <= 3 and {f.split("/")[0] for f in stayed} == {f.split("/")[0] for f in before} - parts and len(stayed) >= 12


def test_generations_survive_a_writer_that_stops(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda v: spark.createDataFrame([(v,)], "v int")
    with pytest.raises(FileNotFoundError):
        sinks.read_generation(spark, path)
    assert [sinks.write_generation(table(v), path) for v in (1, 2)] == [1, 2]
    assert sinks.read_generation(spark, path).first().v == 2
    table(3).write.parquet(f"{path}/gen-000003")  # a writer that stopped before the pointer
    assert sinks.read_generation(spark, path).first().v == 2
    (tmp_path / "t" / "gen-000004").mkdir()  # and one that stopped within the data
    assert sinks.read_generation(spark, path).first().v == 2
    assert sinks.write_generation(table(5), path) == 5 and sinks.read_generation(spark, path).first().v == 5
    assert sinks.generations(spark, path) == [5, 3]
    (tmp_path / "t" / "gen-000005" / "_SUCCESS").unlink()  # a damaged generation: the one before
    assert sinks.read_generation(spark, path).first().v == 3


def test_files_go_with_their_rows(spark, tmp_path):
    for name in ("a.json", "a.json.bak", "b.json"):
        (tmp_path / name).write_text("{}")
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips" / "x.mp3").write_text("x")
    rows = spark.createDataFrame([(str(tmp_path / "a.json"),), (str(tmp_path / "b.json"),), ("cloud::u",)], "path string")
    kept = sinks.delete_projects(rows, rows.filter("path like '%a.json' or path like 'cloud%'"), files=True)
    assert sorted(r.path for r in kept.collect()) == [str(tmp_path / "b.json"), "cloud::u"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.json", "clips"]
    sinks.clear(rows, str(tmp_path / "index"), str(tmp_path / "clips"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 0 and not (tmp_path / "clips").exists()
