"""Chapters, segments, dialogue and markup on literal texts, and folds against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from fablespark.functions.text import find_spans
from fablespark.operators import chapters as CH
from fablespark.operators import dialogue as D
from fablespark.operators import ssml as S
from fablespark.operators import voices as V


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_desktop_chapters(spark):
    body = "Rain fell on the town. " * 12
    texts = [f"Chapter 1\n{body}\n\nChapter Two: The Sea\n{body}", "Before.\nChapter 1\nAfter.", f"Intro\nPART I\n{body}\n7.\n{body}", "", None, f"CHAPTER 1\nChapter 2\n{body}\nChapter 3\n{body}"]
    got = {}
    for r in CH.split_chapters(table(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.chapter_idx, r.title, r.text[:9]))
    assert got[0] == [(0, "Chapter 1", "Chapter 1"), (1, "Chapter Two: The Sea", "Chapter T")]
    assert got[1] == [(0, "Chapter 1", "Before.\nC")]
    assert [c[1] for c in got[2]] == ["PART I", "7."]
    assert got[3] == got[4] == [(0, "Chapter 1", "")]
    assert [c[1] for c in got[5]] == ["CHAPTER 1", "Chapter 3"]  # the second heading is too close to the first
    kept = CH.split_chapters(table(spark, texts[2:3]), keep_prologue=True).orderBy("chapter_idx").collect()
    assert [r.title for r in kept] == ["Prologue", "PART I", "7."]


def test_web_chapters(spark):
    texts = ["Before.\nChapter 1\nAfter.", "Chapter 1\nRain fell.\n\nChapter 2\nIt stopped.", "no heading", "Only text\nPart II", "Chapter 1\n\nChapter 2\nx", "", "book iv: long " + "x" * 120 + "\ny", "Chapterless 1\nz"]
    got = {}
    for r in CH.split_chapters_web(table(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.title, r.text))
    assert got == {
        0: [("Prologue", "Before."), ("Chapter 1", "After.")], 1: [("Chapter 1", "Rain fell."), ("Chapter 2", "It stopped.")], 2: [("Chapter 1", "no heading")],
        3: [("Chapter 1", "Only text")], 4: [("Chapter 2", "x")], 6: [("Chapter 1", "book iv: long " + "x" * 120 + "\ny")], 7: [("Chapter 1", "Chapterless 1\nz")],
    }


def test_scene_breaks(spark):
    text = "a\n***\nb\n* * *\nc\n---\nd\n~~~\ne\n#\nf\n\n\n\ng"
    got = table(spark, [text]).select(CH.scene_breaks(F.col("text")).alias("x")).first().x
    want = sorted({m.start() for p in CH.SCENE_PATTERNS for m in re.finditer(p, text)})
    assert got == want and len(got) >= 6


def plain_pack(text, most):
    if len(text) <= most:
        return [text.strip()]
    chunks, now = [], []
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z\"“])", text.strip()) if x.strip()):
        if now and sum(len(x) + 1 for x in now) + len(s) + 1 > most:
            chunks.append(" ".join(now))
            now = []
        now.append(s)
    return chunks + ([" ".join(now)] if now else [])


def random_text(rng, n):
    return "".join(rng.choice(["Word ", "a ", "stop. ", "Mr. X ", "why? ", "yes! ", '"Quote." ', "\n\n", "long" * 30 + " ", "é ", "etc. "]) for _ in range(n))


def test_packing_matches_python(spark):
    rng = random.Random(1)
    texts = [random_text(rng, rng.randint(0, 200)) for _ in range(60)] + ["", "x" * 500]
    got = table(spark, texts).select("doc_id", CH.pack_sentences(F.col("text"), 300).alias("c")).orderBy("doc_id").collect()
    assert [r.c for r in got] == [plain_pack(t, 300) for t in texts]


def test_web_chunks_fit_and_lose_nothing(spark):
    rng = random.Random(2)
    texts = [random_text(rng, rng.randint(1, 400)) for _ in range(40)] + ["", "short", " ".join(f"w{i}" for i in range(1000)) + ".", "z" * 1500]
    got = table(spark, texts).select("doc_id", CH.chunk_web(F.col("text"), 400).alias("c")).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        assert all(1 <= len(c) <= 400 for c in r.c)
        assert re.sub(r"\s+", "", "".join(r.c)) == re.sub(r"\s+", "", text)
    assert got[-4].c == [] and got[-3].c == ["short"] and len(got[-2].c) > 10 and [len(c) for c in got[-1].c] == [400, 400, 400, 300]


def test_segments(spark):
    text = 'One. Two.\n\n***\n\nThree here.\n\n---\n\nFour.'
    got = CH.segments(table(spark, [text]), ["doc_id"]).orderBy("seg_idx").collect()
    assert [(r.seg_idx, r.text, r.epoch) for r in got] == [(0, "One. Two.", 0), (1, "Three here.", 1), (2, "---", 1), (3, "Four.", 1)]
    assert [text[r.start : r.end] for r in got] == [r.text for r in got]
    assert got[0].scene_break_after and all(r.paragraph_break_after for r in got)


def test_dialogue_attribution(spark):
    texts = ['"Go," Mara said. "Now." Oren whispered, "Why?"', "«Oui» “Non” „Ja“ 「hai」", '"One," Mara said.\n\n"Two," Oren said.\n\n"Three."\n\n"Four."', "none", '"A," Mara said, "B."']
    got = {}
    for r in D.detect_dialogue(table(spark, texts), ["doc_id"]).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.speaker, r.method) for r in got[2]] == [("Mara", "regex"), ("Oren", "regex"), ("Mara", "alternation"), ("Oren", "alternation")]
    assert {r.quote_style for r in got[1]} == {"guillemet", "curly", "german", "cjk_corner"}
    assert all(0 < r.confidence <= 1 for rs in got.values() for r in rs) and 3 not in got
    regex = D.detect_dialogue(table(spark, texts[4:]), ["doc_id"], "regex_only").collect()
    assert [(r.speaker, r.dialogue) for r in regex] == [("Mara", "A, ... B.")]
    assert {r.speaker for r in D.detect_dialogue(table(spark, texts), ["doc_id"], "quotes_only").collect()} == {None}


def test_nearest_entity(spark):
    text = 'Near Oren stood. "Hello there." And Mara ' + "x" * 600 + ' "Far."'
    names = spark.createDataFrame([(0, "Oren", text.index("Oren")), (0, "Mara", text.index("Mara"))], "doc_id int, name string, position int")
    got = D.detect_dialogue(table(spark, [text]), ["doc_id"], entities=names).orderBy("start").collect()
    assert [(r.speaker, r.method, r.confidence) for r in got] == [("Oren", "spacy", 0.7), (None, "unattributed", 0.2)]


def test_drop_overlaps_matches_all_pairs(spark):
    rng = random.Random(3)
    sets = [[(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 15)))] for _ in range(100)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<struct<start:int,end:int>>")
    for r in df.select("i", D.drop_overlaps(F.col("s")).alias("k")).collect():
        kept = []
        for a, b in sorted(sets[r.i], key=lambda x: (x[0], -(x[1] - x[0]))):
            if all(b <= c or a >= d for c, d in kept):
                kept.append((a, b))
        assert [(x.start, x.end) for x in r.k] == kept


def test_alternation_matches_python(spark):
    rng = random.Random(4)
    runs = [[(rng.choice(["A", "B", "C", None, None]), rng.random() < 0.8) for _ in range(rng.randint(0, 25))] for _ in range(100)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, t array<struct<speaker:string,ask:boolean>>")
    for r in df.select("i", D.alternate(F.col("t")).alias("w")).collect():
        memory, want = [], []
        for speaker, ask in runs[r.i]:
            if speaker is None and ask and len(memory) == 2 and memory[0] != memory[1]:
                speaker = memory[1]
            if speaker is not None:
                memory = [speaker, *memory][:2]
            want.append(speaker)
        assert r.w == want


def test_interval_first_matches_loops(spark):
    rng = random.Random(5)
    left = [(k % 3, i, a, a + rng.randint(1, 50)) for i, (k, a) in enumerate((rng.randint(0, 9), rng.randint(0, 500)) for _ in range(120))]
    right = [(k, a, a + rng.randint(1, 40), f"v{k}_{a}") for k in range(3) for a in rng.sample(range(500), 20)]
    got = D.interval_first(spark.createDataFrame(left, "k int, i int, start int, end int"), spark.createDataFrame(right, "k int, start int, end int, v string"), ["k"], ["v"], 64)
    want = {i: next((v for _, s, e, v in sorted((x for x in right if x[0] == k), key=lambda x: (x[1], x[2])) if not (b <= s or a >= e)), None) for k, i, a, b in left}
    assert {r.i: r.v for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_interval_first_keeps_repeated_rows_and_null_keys(spark):
    left = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), (None, 0, 10), (None, 90, 95), ("b", 5, 6)], "k string, start int, end int")
    right = spark.createDataFrame([("a", 5, 7, "x"), ("a", 3, 4, "y"), (None, 1, 2, "z")], "k string, start int, end int, v string")
    got = D.interval_first(left, right, ["k"], ["v"], 4).collect()
    want = [("a", 0, 10, "y"), ("a", 0, 10, "y"), (None, 0, 10, "z"), (None, 90, 95, None), ("b", 5, 6, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_segments_of_many_paragraphs(spark):
    """A book of 10,000 paragraphs with breaks: its parts do not each carry the book."""
    paras = ["***" if i % 50 == 49 else f"Line {i} of it." for i in range(10_000)]
    df = table(spark, ["\n\n".join(paras)])
    segs = CH.segments(df, ["doc_id"]).orderBy("seg_idx").collect()
    own = [p for p in paras if p != "***"]
    assert [r.text for r in segs] == own and [r.epoch for r in segs] == [i // 49 for i in range(len(own))]
    assert [r.scene_break_after for r in segs] == [i % 49 == 48 for i in range(len(own))]
    assert all("\n\n".join(paras)[r.start : r.end] == r.text for r in segs[::97])


def test_long_folds(spark):
    """Thousands of spans, markers and turns in one array, against plain loops."""
    rng = random.Random(9)
    spans = [(a, a + rng.randint(1, 30)) for a in (rng.randint(0, 60_000) for _ in range(4000))]
    turns = [(rng.choice([None, None, "A", "B", "C"]), rng.random() < 0.8) for _ in range(4000)]
    df = spark.createDataFrame([([{"start": a, "end": b} for a, b in spans], [{"speaker": s, "ask": k} for s, k in turns])], "s array<struct<start:int,end:int>>, t array<struct<speaker:string,ask:boolean>>")
    r = df.select(D.drop_overlaps(F.col("s")).alias("s"), D.alternate(F.col("t")).alias("t")).first()
    kept, end = [], -1
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a >= end:
            kept.append((a, b))
            end = b
    assert [tuple(x) for x in r.s] == kept
    memory, want = [], []
    for s, ask in turns:
        if s is None and ask and len(memory) == 2 and memory[0] != memory[1]:
            s = memory[1]
        if s is not None:
            memory = [s, *memory][:2]
        want.append(s)
    assert r.t == want


def test_attributed_segments(spark):
    text = '"One," Mara said.\n\n"Two," Oren said.\n\nRain fell.\n\n"Three."\n\n***\n\n"Four."'
    chapters = table(spark, [text])
    got = D.attribute_segments(CH.segments(chapters, ["doc_id"]), D.detect_dialogue(chapters, ["doc_id"], "regex_only"), ["doc_id"]).orderBy("seg_idx").collect()
    assert [(r.speaker, r.speaker_method) for r in got] == [("Mara", "regex"), ("Oren", "regex"), ("narrator", "narration"), ("Mara", "alternation_span"), ("narrator", "narration")]


def test_web_paragraphs(spark):
    text = 'Rain fell. "Stop!" cried Mara. He said nothing. “Go,” Oren said.'
    df = table(spark, [text]).withColumn("f", find_spans(F.col("text"), D.WEB_QUOTES))
    got = df.select(D.chunk_paragraph(F.col("text"), F.col("f")).alias("c")).first().c
    assert [(c.text, c.is_dialogue) for c in got] == [("Rain fell.", False), ("Stop!", True), ("cried Mara.", False), ("He said nothing.", False), ("Go,", True), ("Oren said.", False)]
    # the second quote's surroundings say "He said" first, which names nobody, then "cried Mara"
    assert [c.speaker for c in got if c.is_dialogue] == ["Mara", "Mara"]
    merged = D.chunks_web(table(spark, [text + "\n\nMore rain."]), ["doc_id"]).orderBy("index").collect()
    assert [r["index"] for r in merged] == list(range(len(merged))) and "cried Mara. He said nothing." in [r.text for r in merged]
    counts = D.speaker_counts(D.chunks_web(table(spark, [text] * 2), ["doc_id"]), ["doc_id", "index"]).collect()
    assert [(r.name, r["count"]) for r in counts] == [("Mara", 4)]


def test_voices(spark):
    v = V.catalogue(spark)
    assert v.count() == 39 and v.filter("supports_express_as").count() == 17 and v.filter("not id like '%Neural'").count() == 0
    assert [r.id for r in V.page(v, 99).collect()] == [r.id for r in v.orderBy("locale", "id").collect()][36:]
    styles = F.array(F.lit("sad"), F.lit("cheerful"), F.lit("whispering"))
    pick = lambda s: spark.range(1).select(V.resolve_style(styles, F.lit(s).cast("string"))).first()[0]
    assert [pick(s) for s in ("whisper", "Sad", "excited", "natural", "angry", None, "dramatic")] == ["whispering", "sad", "cheerful", None, None, None, "sad"]


def test_assign_voices(spark):
    segs = spark.createDataFrame([(0, "narrator", "old", "cached", "f"), (1, "Mara", "m", "cached", "f"), (2, "Oren", "", "cached", "f"), (3, None, "n", "cached", "f")], "i int, speaker string, voice string, status string, cache_file string")
    given = spark.createDataFrame([("Mara", "m")], "speaker string, voice string")
    got = V.assign_voices(segs, given, "n", "d", auto=False).orderBy("i").collect()
    assert [(r.voice, r.status, r.cache_file) for r in got] == [("n", "pending", None), ("m", "cached", "f"), ("d", "cached", "f"), ("n", "cached", "f")]


def test_markup(spark):
    rows = table(spark, ['He wept. "Run now!" she said; then -- quiet.', "", "[sad] tag [angry]"])
    for styles in (F.array(F.lit("sad"), F.lit("cheerful")), None):
        got = {r.doc_id: r.ssml for r in S.with_markup(rows, styles=styles).collect()}
        for r in got.values():
            assert r.startswith("<speak") and r.endswith("</speak>") and "role=" not in r
            used = set(re.findall(r'express-as style="([^"]+)"', r))
            assert used <= ({"sad", "cheerful"} if styles is not None else set())
        assert ">...</prosody>" in got[1] and "[sad]" not in got[2] and "[angry]" not in got[2]
        assert '<emphasis level="moderate">Run</emphasis>' in got[0] and '<break time="120ms"/>' in got[0] and 'rate="+2%" pitch="+2Hz"' in got[0]
    n = S.with_markup(rows).select(S.feature_counts(F.col("ssml")).alias("n")).collect()[0].n
    assert n.prosody == 3 and n.emphasis == 2 and n.express_as == 0
    assert S.with_markup(rows, rate=F.lit(3.0), pitch=F.lit(-2.0), volume=F.lit(5.0)).filter("doc_id = 2").first().ssml.count('rate="+50%" pitch="-2Hz" volume="+5%"') == 1


def test_chapters_of_a_text_with_very_many(spark):
    """Pieces are cut in one pass: 60,000 chapters of one text take seconds, and are those of plain slices."""
    import time

    body = "and so on, " * 19
    text = "Before.\n\n" + "\n\n".join(f"Chapter {i}\n\nPART 2\n\n\u00e9{body}." for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "no heading"), (3, None)], "id int, text string")
    begun = time.time()
    got = CH.split_chapters(df).select("id", "chapter_idx", "title", F.md5("text").alias("md5")).collect()
    assert time.time() - begun < 60
    want = {(1, i): (f"Chapter {i}", hashlib.md5(f"Chapter {i}\n\nPART 2\n\n\u00e9{body}.".encode()).hexdigest()) for i in range(60_000)}
    want |= {(i, 0): ("Chapter 1", hashlib.md5(t.encode()).hexdigest()) for i, t in ((2, "no heading"), (3, ""))}
    assert {(r.id, r.chapter_idx): (r.title, r.md5) for r in got} == want


def test_spans_of_a_batch_are_made_a_few_texts_at_a_time():
    import pyarrow as pa

    from fablespark.functions import text as X

    column = pa.array(["ab" * 1000, None, ""] * 2000)
    parts = list(X._slices(column))
    assert [t for p in parts for t in p] == column.to_pylist() and len(parts) > 5 and max(sum(len(t or "") for t in p) for p in parts) <= X._SLICE + 2000
