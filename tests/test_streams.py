"""Streams against the same work on tables: alternation with an end, repeats, intervals."""

import datetime as dt
import time
import uuid

from pyspark.sql import functions as F

from fablespark.streaming import live

BASE = dt.datetime(2024, 1, 1)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def run(query_of, name, steps):
    q = query_of.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for step in steps:
            step()
            q.processAllAvailable()
    finally:
        q.stop()


def plain_alternation(turns):
    out, last = {}, {}
    for conv, turn, who in sorted(turns):
        a, b = last.get(conv, (None, None))
        if who is None and a is not None and b is not None and a != b:
            who = b
        if who is not None:
            last[conv] = (who, a)
        out[conv, turn] = who
    return out


def poll(spark, stream, steps, seconds=60):
    """Rows of a stream that is never idle, as its state has a time to live: each step waits for a number of rows."""
    name = "t" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for step, rows in steps:
            step()
            end = time.time() + seconds
            while spark.table(name).count() < rows and time.time() < end and q.isActive:
                time.sleep(0.3)
        return spark.table(name).collect()
    finally:
        q.stop()


def test_alternation_of_replayed_conversations(spark, tmp_path):
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role")
    turns = [(r.conv_id, r.turn, None if r.turn % 3 == 2 else r.role) for r in c.filter("turn is not null and conv_id is not null").dropDuplicates(["conv_id", "turn"]).collect()]
    schema, path = "conv_id long, turn long, speaker string", f"{tmp_path}/in"
    first = [t for t in turns if t[1] < 2]
    feed(spark, path, first, schema)
    s = spark.readStream.schema(schema).json(path)
    rows = poll(spark, live.attribute_turns(s), [(lambda: None, len(first)), (lambda: feed(spark, path, [t for t in turns if t[1] >= 2], schema), len(turns))])
    assert len(turns) > 20 and {(r.conv_id, r.turn): r.speaker for r in rows} == plain_alternation(turns)


def test_alternation_forgets_silent_keys(spark, tmp_path):
    schema, path = "conv_id string, turn long, speaker string", f"{tmp_path}/in"
    feed(spark, path, [("a", 0, "X"), ("a", 1, "Y")], schema)
    s = spark.readStream.schema(schema).json(path)
    later = lambda: (time.sleep(3), feed(spark, path, [("a", 2, None)], schema))
    rows = poll(spark, live.attribute_turns(s, ttl=dt.timedelta(seconds=1)), [(lambda: None, 2), (later, 3)])
    assert {r.turn: r.speaker for r in rows} == {0: "X", 1: "Y", 2: None}


def test_repeats_within_the_watermark(spark, tmp_path):
    schema, path = "conv_id long, turn long, ts timestamp", f"{tmp_path}/in"
    at = lambda m: BASE + dt.timedelta(minutes=m)
    feed(spark, path, [(1, 0, at(0)), (1, 0, at(1)), (1, 1, at(2))], schema)
    s = spark.readStream.schema(schema).json(path)
    name = "t" + uuid.uuid4().hex
    run(live.drop_repeats(s, ["conv_id", "turn"]), name, [lambda: None, lambda: feed(spark, path, [(1, 1, at(5)), (2, 0, at(6))], schema)])
    assert sorted((r.conv_id, r.turn) for r in spark.table(name).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_intervals_of_two_streams(spark, tmp_path):
    segs = [(k, i, i * 10, i * 10 + 10, BASE + dt.timedelta(minutes=i)) for k in (1, 2) for i in range(12)]
    spans = [(k, p, p + 7, who, BASE + dt.timedelta(minutes=p // 10)) for k, p, who in [(1, 3, "A"), (1, 8, "B"), (1, 20, "C"), (1, 33, None), (2, 97, "D"), (3, 0, "E")]]
    one = "k long, seg_idx long, start long, end long, ts timestamp"
    two = "k long, start long, end long, speaker string, ts timestamp"
    batch = live.attribute_stream(spark.createDataFrame(segs, one), spark.createDataFrame(spans, two), ["k"])
    want = {(k, i): min(((s, e, w) for kk, s, e, w, _ in spans if kk == k and w and a < e and s < b), default=(0, 0, None))[2] for k, i, a, b, _ in segs}
    assert {(r.k, r.seg_idx): r.speaker for r in batch.collect()} == want
    p, q = f"{tmp_path}/segs", f"{tmp_path}/spans"
    feed(spark, p, segs[::2], one)
    feed(spark, q, spans[::2], two)
    s, d = spark.readStream.schema(one).json(p), spark.readStream.schema(two).json(q)
    name = "t" + uuid.uuid4().hex
    far = BASE + dt.timedelta(days=1)
    steps = [lambda: None, lambda: (feed(spark, p, segs[1::2], one), feed(spark, q, spans[1::2], two))]
    for i in range(2):
        steps.append(lambda i=i: (feed(spark, p, [(9, i, 0, 1, far + dt.timedelta(days=i))], one), feed(spark, q, [(9, 0, 1, "Z", far + dt.timedelta(days=i))], two)))
    run(live.attribute_stream(s, d, ["k"]), name, steps)
    rows = spark.table(name).filter(F.col("k") < 9).collect()
    assert len(rows) == len(want) and {(r.k, r.seg_idx): r.speaker for r in rows} == want
