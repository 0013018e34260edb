"""JSON objects whose unknown keys survive a read and a write."""

import json

from pyspark.sql import functions as F

from fablespark.sources import readers


def test_put_keys_keeps_the_rest(spark):
    texts = ['{"a": 1, "b": {"c": [1, null, "x"]}, "k": "old"}', "{}", "[1]", "no json", None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, j string")
    put = readers.put_keys(F.col("j"), {"k": F.col("id"), "s": F.struct(F.col("id").alias("n")), "none": F.lit(None).cast("string")})
    got = {r.id: json.loads(r.o) for r in t.select("id", put.alias("o")).collect()}
    own = lambda i: {"k": i, "s": {"n": i}, "none": None}
    assert got == {0: {"a": 1, "b": {"c": [1, None, "x"]}} | own(0)} | {i: own(i) for i in range(1, 5)}
    assert [sorted(r.m) for r in t.orderBy("id").select(F.map_keys(readers.open_map(F.col("j"))).alias("m")).collect()] == [["a", "b", "k"], [], [], [], []]


def test_manifest_round_trip(spark, tmp_path):
    seg = lambda i, **more: {"index": i, "text": f"t{i}", "status": "pending"} | more
    book = {"title": "T", "isbn": "978"}
    whole = {"version": "1", "book": book, "plugin": {"x": [1, 2]}, "chapters": [{"index": 1, "title": "One", "mood": "dark", "segments": [seg(0, take=3), seg(1)]}, {"index": 0, "title": "Zero", "segments": []}]}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    m = readers.read_manifests(spark, f"file://{tmp_path}").withColumn("version", F.lit("2"))
    raw = spark.read.text(f"file://{tmp_path}/a.json", wholetext=True).select(F.col("value").alias("raw"))
    done = F.transform("chapters", lambda c: c.withField("status", F.lit("done")))
    joined = m.withColumn("chapters", done).crossJoin(F.broadcast(raw))  # one manifest
    back = json.loads(joined.select(readers.manifest_text(joined, F.col("raw")).alias("o")).first().o)
    assert back["version"] == "2" and back["plugin"] == {"x": [1, 2]} and back["book"] == book
    assert [(c["index"], c.get("mood"), c["status"]) for c in back["chapters"]] == [(1, "dark", "done"), (0, None, "done")]
    assert back["chapters"][0]["segments"][0]["take"] == 3 and "take" not in back["chapters"][0]["segments"][1]
    assert back["runtime"]["state"] == "idle"
