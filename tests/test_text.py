"""Column functions on literal texts."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from fablespark.functions import emotion as E
from fablespark.functions import hashing as H
from fablespark.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def over(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    assert over(spark, X.normalize_text, ["a\r\nb\rc \t\nd\n\n\n\ne f  ", None, " \n "]) == ["a\nb\nc\nd\n\ne f", "", ""]


def test_slug_and_escapes(spark):
    assert over(spark, X.slugify, ["  My Book: Part 1! ", "...", None, "é"]) == ["My_Book_Part_1", "book", "book", "_".strip("._") or "book"]
    assert over(spark, X.xml_escape, ["<a & 'b' \"c\">"]) == ["&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;"]
    assert over(spark, X.html_escape, ["'", None]) == ["&#39;", ""]


def test_clean_desktop(spark):
    texts = ["Dr. Who &amp; Mrs. X — <b>bold</b> WAIT!!! no... STOP *now* NASAs", "St. John lives on Main St.", "etc. vs. JR."]
    assert over(spark, X.clean_desktop, texts) == ["Doctor Who & Missus X, bold Wait! no… Stop now NASAs", "Saint John lives on Main St.", "et cetera versus Junior"]


def test_clean_web(spark):
    assert over(spark, X.clean_web, ["“Hi” ‘x’ a—b–c…\x07  d\n e", None]) == ["\"Hi\" 'x' a — b – c... d e", ""]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><p>One<br>two</p><div>A &amp; B</div><script>var x=1;</script></body></html>"
    assert over(spark, X.html_blocks_to_text, [page]) == ["One\ntwo\n\nA & B"]
    assert over(spark, X.html_to_text, ["<p>a<style>s{}</style>\n<b>b</b></p>", ""]) == ["a b", ""]


def test_sentences(spark):
    assert over(spark, X.sentences, ['One. Two! "Three?" four. five', " A.B c. D "]) == [["One.", "Two!", '"Three?" four. five'], ["A.B c.", "D"]]
    assert over(spark, X.guarded_sentences, ["Mr. Smith met Dr. Jones. They left! ok"]) == [["Mr. Smith met Dr. Jones.", "They left!", "ok"]]


def test_pronunciation(spark):
    entries = [("tom", "Tohm"), ("a.b", "x$1\\y"), ("Tohm", "T")]
    assert over(spark, lambda t: X.apply_pronunciation(t, entries), ["Tom atom TOM. a.b acb", ""]) == ["T atom T. x$1\\y acb", ""]


def test_voice_string(spark):
    got = over(spark, X.parse_voice, ["v|pitch=+2Hz|rate=-5%", "v", "v|pitch=bad|pitch=-3.5Hz"])
    assert [tuple(g) for g in got] == [("v", "+2Hz", 2.0, "-5%"), ("v", "+0Hz", 0.0, None), ("v", "-3.5Hz", -3.5, None)]


def test_names_and_messages(spark):
    assert over(spark, X.clean_speaker, ["Mara,", "He", "x", "Mr Smith", None, "Ann Lee—"]) == ["Mara", None, None, None, None, "Ann Lee"]
    assert over(spark, X.progress_message, ["Generated chapter 2, segment 5 (Mara)", "generated chapter 1, segment 1", "Error on chapter 3 , segment 4: boom ", "Already cached x", " ", "other"]) == [
        "Generating audio · Chapter 2, segment 5 · Speaker Mara", "Generating audio · Chapter 1, segment 1", "Issue in chapter 3, segment 4: boom", "Using cached audio", "Generating audio", "other",
    ]
    assert [c.category for c in over(spark, X.error_class, ["read timed out", "ffprobe missing", "DNS failure", "odd"])] == ["Network timeout", "System dependency", "Network", "Processing"]
    assert over(spark, X.state_badge, ["completed", "", "queued up"]) == ["✅ **Completed**", "⚪ **Idle**", "⚪ **Queued Up**"]


def test_labels(spark):
    assert over(spark, X.dialogue_strategy, ["Regex only (faster)", "Quotes", "", None]) == ["regex_only", "quotes_only", "auto", "auto"]
    assert over(spark, X.speed_mode, ["Post-process", "x"]) == ["post_process", "native"]
    assert over(spark, X.output_format_label, ["m4b x", "mp3"])[0].startswith("M4B")
    assert over(spark, X.file_kind, ["A.EPUB", "b.pdf", "c.docx", "d.md", "e.mobi", "f.xyz"]) == ["epub", "pdf", "docx", "text", None, "text"]


def test_urls(spark):
    urls = ["http://example.org/x", "https://127.0.0.1/", "http://localhost:8000", "ftp://example.org", "http://10.1.2.3", "https://[::1]/", "http://user@192.168.1.1/", "https://a.b:443/p", "http://", "http://172.20.0.1"]
    assert over(spark, X.url_is_safe, urls) == [True, False, False, False, False, False, False, True, False, False]
    assert over(spark, lambda u: X.url_is_safe(u, ["example.org"]), ["https://www.example.org/", "https://badexample.org/"]) == [True, False]
    assert over(spark, X.url_host, ["https://a.b:443/p"]) == ["a.b:443"]


def test_eta(spark):
    assert [one(spark, X.eta_text(F.lit(s))) for s in (-4, 59, 61, 3661)] == ["00:00", "00:59", "01:01", "01:01:01"]


def test_spans_match_python(spark):
    text = 'x "a" é "b" 😀 "c"'
    got = over(spark, lambda t: X.find_spans(t, '"(.)"'), [text, None])
    assert [(s.start, s.end, s.groups) for s in got[0]] == [(m.start(), m.end(), [m[0], m[1]]) for m in re.finditer('"(.)"', text)] and got[1] == []


def test_hashes(spark):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    key = lambda speed, mode: one(spark, H.cache_key(F.lit("t"), F.lit("v"), F.lit("e"), F.lit(speed), mode=F.lit(mode)))
    assert key(1.2, "post_process") == key(0.8, "post_process") != key(1.2, "native") != key(0.8, "native")
    assert key(1.0, "native") == md5("v=3|t|v|e|1.0||native|style=default|exp=0.00|role=|ebias=")
    assert one(spark, H.text_hash(F.lit("t"), F.lit("v"), F.lit("e"), F.lit(1.0))) == md5("t|v|e|1.0")
    m = {"b": 'x"y', "a": "1]"}
    assert one(spark, H.map_hash(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)))) == md5(json.dumps(m, sort_keys=True))
    for name in ("Mara", "Oren", "Ünal", ""):
        assert one(spark, H.pick_index(F.lit(name))) == int(md5(name), 16) % 12
    assert one(spark, H.content_signature(F.lit("x" * 3000))) == md5("x" * 2000)[:10] and one(spark, H.content_signature(F.lit(""))) == "empty"


def test_emotion(spark):
    text = "He cried in grief. She was furious, furious!"
    got = one(spark, E.detect_emotion(F.lit(text), F.lit(0.68)))
    assert (got.name, got.style, got.degree) == ("sad", "sad", f"{1.15 * (0.6 + 0.68 * 0.85):.1f}")  # a tie: the earlier rule
    assert one(spark, E.detect_emotion(F.lit("nothing here"), F.lit(0.68))) is None and one(spark, E.detect_emotion(F.lit(text), F.lit(0.1))) is None
    for dialect, rules in E.RULES.items():
        for name, pattern, *_ in rules:
            for word in re.sub(r"\(\?!.*?\)|\\b|[().?]", "", pattern).split("|"):
                n = {r.name: r.n for r in one(spark, E.rule_counts(F.lit(f"x {word.upper()} y"), dialect))} if word in ("grief", "hell", "crossed") else {name: 1}
                assert n[name] >= (word != "crossed")


def test_auto_style(spark):
    got = over(spark, E.auto_style, ["Amazing", "wow!!", "why?", "measure", "quiet", None])
    assert [(g.style, round(g.boost, 2)) for g in got] == [("ecstatic", 0.15), ("excited", 0.25), ("conversational", 0.0), ("sarcastic", 0.15), ("natural", 0.0), ("natural", 0.0)]


def test_styles(spark):
    s = one(spark, E.direct(F.lit("natural"), F.lit(0.6), F.lit("Whispering, then SAD")))
    assert s.style == "whispering" and abs(s.expressiveness - (0.6 + 0.1 + 0.1 + 0.09)) < 1e-9
    s = one(spark, E.biased(F.lit("natural"), F.lit(0.9), F.lit(" Excited ")))
    assert (s.style, s.expressiveness) == ("excited", 0.96)
    assert one(spark, E.express_style(F.lit("intense"), F.lit(True), F.lit(0.5))) == "terrified" and one(spark, E.express_style(F.lit("intense"), F.lit(False), F.lit(0.3))) is None
    p = one(spark, E.provider_settings(F.lit("dramatic"), F.lit(0.9)))
    assert (p.stability, p.style) == (0.05, 1.0)
    assert [one(spark, E.percent(F.lit(x))) for x in (0.0, 0.125, -0.3)] == ["+0%", "+13%", "-30%"]
    assert [one(spark, E.signed(F.lit(x), "Hz")) for x in (0.0, 2.0, -3.5)] == ["+0Hz", "+2Hz", "-3.5Hz"]


def test_tempo(spark):
    assert [one(spark, E.tempo_filter(F.lit(s))) for s in (1.0, 3.0, 0.2, 2.0)] == ["anull", "atempo=2,atempo=1.5", "atempo=0.5,atempo=0.5,atempo=0.8", "atempo=2"]
    with pytest.raises(Exception, match="Speed multiplier"):
        one(spark, E.tempo_filter(F.lit(0.0)))


def test_overrides_of_long_lists(spark):
    """The last of each word, in the order of the rows, without comparing each row with all others."""
    rows = [(f" w{i % 7}" if i % 3 else None, str(i)) for i in range(3000)]
    df = spark.createDataFrame([(rows,), ([],), (None,)], "r array<struct<word:string,sounds_like:string>>")
    found = X.overrides_map(F.col("r"))
    got = [list(zip(r.k, r.v, strict=True)) if r.k is not None else None for r in df.select(F.map_keys(found).alias("k"), F.map_values(found).alias("v")).collect()]
    last = {w.strip(): s for w, s in rows if w}
    assert got == [sorted(last.items(), key=lambda e: int(e[1])), [], None]
    assert "exists" not in df.select(found)._jdf.queryExecution().optimizedPlan().toString()


def test_clean_desktop_looks_for_abbreviations_once(spark):
    """Slow patterns run only where there is an abbreviation or a dash, and the results stay those of one pattern after another."""
    texts = ["Dr.Mr. X", "Mr.Dr. X", "ſr. mſ. aMr. éMr. _vs. vs.", "ST. ſx St. 9 St. Kx", "a —\nb", "no dot", None]
    want = ["DoctorMister X", "MisterDr. X", "Senior Miss aMr. éMr. vs. versus", "Saint ſx St. 9 Saint Kx", "a, b", "no dot", None]
    assert over(spark, X.clean_desktop, texts) == want
    plan = spark.createDataFrame([("",)], "t string").select(X.clean_desktop(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert r"(?iU)\bMr" not in plan and plan.count("RLIKE") >= 2


def test_clean_desktop_as_its_sql(spark, tmp_path):
    """The query against its SQL, where words of an abbreviation stand in a row, at edges of words and in long words of capitals."""
    import duckdb
    import pandas as pd

    from fablespark.plans.queries import ORACLES, QUERIES

    texts = ["st. st. st. st. 9", "St. St. X", "Mr.Mr.mr.MR.Mr. x", "vs.vs. etc.etc.etc.", "²Mr. \u203fMr. \u200dMr. ⒶMr. éMr.", "St. ı St. K", "½ABCD \u203fABCD \u200dABCD", "A" * 41 + " " + "B" * 90 + "x", "\ufeffa\ufeff", "\x1fa \x1c", "", None]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    got = QUERIES["q_clean_desktop"](spark, str(tmp_path)).orderBy("doc_id").collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        assert [tuple(r) for r in got] == con.execute(ORACLES["q_clean_desktop"] + " ORDER BY doc_id").fetchall()
    assert over(spark, lambda t: X.clean_desktop(t, "sql"), texts[:3]) == ["Saint st. Saint st. 9", "Saint St. X", "MisterMr.MisterMR.Mister x"]
    # all are spelled out by default, and words end where they do in the SQL
    assert over(spark, X.clean_desktop, [*texts[:5], texts[7]]) == ["Saint Saint Saint st. 9", "Saint Saint X", "MisterMisterMisterMisterMister x", "versusversus et ceteraet ceteraet cetera", "²Mr. \u203fMister \u200dMister ⒶMister éMr.", "A" + "a" * 40 + " " + "B" * 90 + "x"]
