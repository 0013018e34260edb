"""Reports, cache, projects, sources, sinks, streams and plans."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fablespark.operators import cache as C
from fablespark.operators import projects as P
from fablespark.operators import report as R
from fablespark.sources import readers, sinks
from fablespark.streaming import live


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_empty_chapter_is_complete(spark):
    chapters = spark.createDataFrame([(0,), (1,)], "c int")
    segs = spark.createDataFrame([(1, "cached"), (1, "pending")], "c int, status string")
    assert rows(R.chapter_progress(chapters, segs, ["c"]).orderBy("c")) == [(0, 0, 0, 0, "complete"), (1, 1, 2, 50, "pending")]


def test_errors_and_characters(spark):
    segs = spark.createDataFrame([("Mara", "cached", "a"), ("narrator", "pending", None)], "speaker string, status string, cache_file string")
    files = spark.createDataFrame([("a",)], "path string")
    assert rows(R.has_errors(segs, files)) == [(False,)] and rows(R.has_errors(segs, files.limit(0))) == [(True,)]
    voices = spark.createDataFrame([("Zed", "z", "auto"), ("Mara", "m", "manual")], "speaker string, voice string, detected_by string")
    assert rows(R.character_table(voices, segs)) == [("Mara", "m", "manual", 1), ("Zed", "z", "auto", 0)]
    assert R.markdown_table(voices, ["speaker", "voice"], ["speaker"]).first()[0] == "| speaker | voice |\n|---|---|\n| Mara | m |\n| Zed | z |"


def test_timeline_text(spark):
    segs = spark.createDataFrame([("b", 0, 0, 1.5, "Mara", True, False), ("b", 0, 1, 2.0, "narrator", True, True), ("b", 1, 0, 1.0, None, False, False)], "book string, ch int, seg_idx int, duration_seconds double, speaker string, paragraph_break_after boolean, scene_break_after boolean")
    times = R.timeline(segs, ["book"], "ch")
    assert rows(times.orderBy("ch")) == [("b", 0, 0, 1500 + 500 + 300 + 2000 + 1000 + 2000), ("b", 1, 7300, 8300)]
    titles = spark.createDataFrame([("b", 0, "One", "Book", None), ("b", 1, "Two", "Book", None)], "book string, ch int, title string, book_title string, author string")
    text = R.metadata_text(times, titles, ["book"], "ch").first().text
    assert text.startswith(";FFMETADATA1\ntitle=Book\nartist=Unknown\nalbum=Book\ngenre=Audiobook\n\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=7300\ntitle=One\n")


def test_metrics(spark):
    m = spark.createDataFrame([("p", "parse", "seconds", 1.0, 1), ("p", "parse", "seconds", 2.0, 5), ("p", "generate", "seconds", 9.0, 2)], "project_id string, stage string, name string, value double, ts int")
    assert rows(R.stage_timings(m)) == [("p", 2.0, 9.0, None)]
    assert spark.range(1).select(R.hit_rate(F.lit(0), F.lit(0)), R.hit_rate(F.lit(1), F.lit(3))).first() == (1.0, 0.3333)


def test_cache(spark):
    t = dt.datetime(2024, 1, 1)
    day = lambda d, h=0: t + dt.timedelta(days=d, hours=h)
    cache = spark.createDataFrame([(f"k{i}", f"f{i}", 2.0, 10, day(i // 3, i % 3), "") for i in range(9)], "cache_key string, filename string, duration double, size_bytes long, last_accessed timestamp, sha256 string")
    for most in (0, 5, 10, 25, 60, 90, 1000):
        want = {f"k{i}" for i in range(8, 8 - min(9, most // 10), -1)}
        assert {r.cache_key for r in C.evict(cache, most).collect()} == want
        assert {r.cache_key for r in C.evict(cache.withColumn("g", F.lit(1)), most, ["g"]).collect()} == want
    never = cache.unionByName(cache.limit(2).withColumn("cache_key", F.concat(F.lit("n"), "cache_key")).withColumn("last_accessed", F.lit(None).cast("timestamp")))
    assert {r.cache_key for r in C.evict(never, 95).collect()} == {f"k{i}" for i in range(9)}
    assert len(C.evict(never, 100).collect()) == 10 and len(C.evict(never, 110).collect()) == 11
    files = spark.createDataFrame([("f0", 10, 2.5, "x"), ("f1", 0, 2.0, "x"), ("f2", 5, 2.9, "x"), ("f3", 5, 0.0, "x")], "filename string, size int, measured double, sha string")
    good, gone = C.repair(cache, files)
    assert {r.cache_key for r in good.collect()} == {"k0"} and gone.count() == 8
    assert rows(C.size_and_count(cache)) == [(90 / 1048576, 9)]
    put = C.put(cache.withColumn("created", F.lit(1)), cache.limit(1).withColumn("created", F.lit(2)).withColumn("duration", F.lit(7.0)))
    assert put.count() == 9 and put.filter("duration = 7").count() == 1


def test_inventory_and_resume(spark):
    m = spark.createDataFrame([("m/a.json", "My Book", "parsed", "u1"), ("m/b.json", None, None, ""), ("m/c.bak", "x", "y", "")], "path string, title string, state string, cloud_url string")
    o = spark.createDataFrame([("o/My_Book.mp3", "My_Book.mp3", "My_Book", "mp3"), ("o/My_Book.m4b", "My_Book.m4b", "My_Book", "m4b"), ("o/z.wav", "z.wav", "z", "wav")], "path string, name string, stem string, ext string")
    inv = P.inventory(spark, m, o, "u2")
    got = {r.id: r for r in inv.collect()}
    assert set(got) == {"local::m/a.json", "local::m/b.json", "cloud::u1", "cloud::u2", "output::o/My_Book.mp3"}
    assert got["local::m/a.json"].output_path == "o/My_Book.m4b" and got["local::m/b.json"].title == "b" and got["local::m/a.json"].label == "My Book · parsed · local"
    pick = lambda *a, **k: P.resume_choice(inv, *a, **k).first().id
    assert pick("cloud::u1", "cloud::u2", None) == "cloud::u1" and pick("cloud::u1", "cloud::u2", None, prefer_last=True) == "cloud::u2"
    assert pick("gone", None, "m/b.json") == "local::m/b.json" and pick(None, None, None) == "cloud::u1"
    assert P.project_markdown(inv.filter("id = 'cloud::u1'")).first().markdown == "**Title:** Cloud backup\n\n**State:** cloud\n\n**Storage:** cloud\n\n**Cloud URL:** `u1`"
    assert sinks.delete_projects(m.withColumnRenamed("title", "t"), m.filter("path like '%a.json'").select("path")).count() == 2


def test_jobs(spark):
    s = lambda c, t, n: tuple(spark.range(1).select(P.job_status(F.lit(c), F.lit(t), F.lit(n)).alias("s")).first().s)
    assert s(0, 10000, 500) == (5, "queued", 10) and s(0, 10000, 5500) == (55, "processing", 5) and s(0, 500, 2000) == (100, "completed", 0)
    bodies = spark.createDataFrame([('{"detail":{"status":"quota_exceeded","message":"none left"}}',), ('{"detail":"slow down"}',), (None,)], "b string")
    assert rows(bodies.select(P.quota_or_rate(F.col("b")), P.error_detail(F.col("b"), "?"))) == [("quota", "none left"), ("rate_limit", "slow down"), ("rate_limit", "?")]
    assert spark.range(1).select(P.request_problem(F.lit(" ")), P.request_problem(F.lit("x" * 9), 8), P.request_problem(F.lit("x"))).first() == (400, 413, None)


def test_text_and_archives(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "My tale.txt").write_text("Once\nupon", "utf-8")
    assert rows(readers.read_text(spark, f"file://{tmp_path}/t").select("title", "text")) == [("My tale", "Once\nupon")]
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/a.xhtml", "<html><body><h1>Alpha</h1><p>" + "first words " * 10 + "</p></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><p>" + "second words " * 10 + "</p></body></html>")
        z.writestr("OPS/c.xhtml", "<p>not in the spine</p>")
    got = readers.read_epub(spark, f"file://{tmp_path}/b.epub").orderBy("chapter_idx").collect()
    assert [(r.title, r.text[:11]) for r in got] == [("Alpha", "Alpha\nfirst"), ("Chapter 2", "second word")]
    assert readers.read_epub(spark, f"file://{tmp_path}/b.epub", whole=True).count() == 1
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    assert [(r.title, r.text) for r in readers.read_docx(spark, f"file://{tmp_path}/d.docx").collect()] == [("d", "One line\n\nTwo")]
    (tmp_path / "n.odd").write_text("Plain words")
    got = {r.path.rsplit("/", 1)[1]: (r.source_type, r.title) for r in readers.read_sources(spark, f"file://{tmp_path}/*.{{docx,odd}}").collect()}
    assert got == {"d.docx": ("docx", "d"), "n.odd": ("text", "n")}
    assert {r.source_type for r in readers.read_sources(spark, f"file://{tmp_path}/b.epub").collect()} == {"epub"}
    (tmp_path / "old.mobi").write_bytes(b"x")
    with pytest.raises(Exception, match="no reader"):
        readers.read_sources(spark, f"file://{tmp_path}/old.mobi").collect()
    assert readers.read_sources(spark, f"file://{tmp_path}/old.mobi", raw_text="Pasted").first().text == "Pasted"
    page = spark.createDataFrame([("https://x.org/a", "<p>One</p><nav><nav>in</nav>still in</nav>Two &eacute;<br>Three")], "url string, html string")
    assert readers.read_sources(spark, pages=page).first().title == "x.org"
    assert readers.pages_to_documents(page, "dom").first().text == "One\n\nTwo é\nThree"
    files = readers.list_files(spark, f"file://{tmp_path}", "*.docx")
    assert [(r.name, r.stem, r.ext) for r in files.collect()] == [("d.docx", "d", "docx")]
    assert readers.stale_files(files, F.lit(dt.datetime(2100, 1, 1))).count() == 1
    with pytest.MonkeyPatch.context() as m, pytest.raises(Exception, match="too large"):
        m.setattr(readers, "MOST_BYTES", 10)
        readers.read_docx(spark, f"file://{tmp_path}/d.docx").collect()


def test_pdf(spark):
    chars = spark.createDataFrame([(1, 10.0, 5.0, 20.0, "B"), (1, 10.4, 1.0, 20.0, "A"), (1, 30.0, 1.0, 10.0, "x"), (3, 10.0, 1.0, 18.0, "C")], "page int, top double, x0 double, size double, text string").withColumn("d", F.lit(0))
    lines = readers.pdf_lines(chars, ["d"])
    assert {(r.page, r.text, r["size"]) for r in lines.collect()} == {(1, "AB", 20.0), (1, "x", 10.0), (3, "C", 18.0)}
    pages = spark.createDataFrame([(0, p, f"p{p}") for p in (1, 2, 3)], "d int, page int, text string")
    assert [(r.title, r.text) for r in readers.pdf_chapters(pages, lines, ["d"]).orderBy("chapter_idx").collect()] == [("AB", "p1\np2"), ("C", "p3")]
    assert [r.title for r in readers.pdf_chapters(pages, lines, ["d"], True).orderBy("chapter_idx").collect()] == ["C", "Chapter 2"]


def test_manifest_recovery(spark, tmp_path):
    good = {"book": {"title": "T"}, "chapters": [{"title": "c", "segments": [{"text": "x", "status": "cached"}, {"text": "y"}]}]}
    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "a.json.bak").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({"book": {"title": "U"}, "runtime": {"state": "generated"}}))
    m = readers.read_manifests(spark, f"file://{tmp_path}").orderBy("path").collect()
    assert [(r.book.title, r.runtime.state, r.settings.tts_engine) for r in m] == [("T", "idle", "edge-tts"), ("U", "generated", "edge-tts")]
    segs = readers.manifest_segments(readers.read_manifests(spark, f"file://{tmp_path}")).orderBy("seg_idx").collect()
    assert [(r.seg_idx, r.text, r.status) for r in segs] == [(0, "x", "cached"), (1, "y", "pending")]
    sinks.write_manifests(readers.read_manifests(spark, f"file://{tmp_path}").drop("path"), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_sinks(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "i int, v string"), ["i"], "v", f"file://{tmp_path}/l")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/l").collect()) == ["a", "b"]
    sinks.clear(spark.range(3), f"file://{tmp_path}/e")
    assert spark.read.parquet(f"file://{tmp_path}/e").count() == 0
    assert rows(spark.createDataFrame([('{"a":"1"}',), ("[1]",), (None,)], "j string").select(F.size(readers.tolerant_map(F.col("j"))))) == [(1,), (0,), (0,)]


def test_streams(spark):
    t = spark.createDataFrame([("she wept in grief",)], "text string")
    assert live.emotion_stream(t).first().emotion.name == "sad"
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1), "a", 1.0)], "ts timestamp, event_type string, value double")
    assert live.activity(e).count() == 1


def test_plans_push_down_and_stay_native(spark):
    from fablespark.plans.queries import QUERIES

    plan = lambda n: QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for name in ("q_entry", "q_normalize", "q_pack", "q_chunk_web", "q_emotion_best", "q_alternation", "q_timeline", "q_lru", "q_inventory_union"):
        p = plan(name)
        assert "Python" not in p and "Arrow" not in p and "NestedLoop" not in p and "CartesianProduct" not in p, name
    assert "ReadSchema: struct<lang:string,n_chars:bigint" not in plan("q_page") and "TakeOrderedAndProject" in plan("q_preview_topk")
    assert "n_chars" not in plan("q_normalize").split("ReadSchema")[1].split("\n")[0]


def test_queries_match_their_sql(spark):
    """Every query with SQL, on the smallest tables."""
    import glob
    import os

    import duckdb

    from fablespark.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
        want = con.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        flat = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))  # noqa: E731, B023
        assert flat(got) == flat(want), name


def test_app_state(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert sinks.load_app_state(spark, path).count() == 0
    sinks.remember_last_project(spark, path, "t1", "p1", "m1")
    sinks.remember_last_project(spark, path, "t2", cloud_url="u2")
    assert rows(sinks.load_app_state(spark, path)) == [("p1", "m1", "u2", "t2")]
