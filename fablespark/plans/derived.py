"""More queries: one for each operator that queries.py reaches only in part, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablespark.functions import emotion as E
from fablespark.functions import hashing as H
from fablespark.functions import text as X
from fablespark.operators import cache as C
from fablespark.operators import chapters as CH
from fablespark.operators import dialogue as D
from fablespark.operators import projects as P
from fablespark.operators import report as R
from fablespark.operators import ssml as S
from fablespark.operators import voices as V
from fablespark.plans.queries import _FELT_SQL, _NIGHT, _RULE_SQL, _SEGS_SQL, ORACLES, _felt, _segs, _t, query

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


# ---- emotion and style ----------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN e < 0.35 THEN NULL ELSE CASE s WHEN 'dramatic' THEN CASE WHEN d THEN 'cheerful' ELSE 'narration-professional' END WHEN 'conversational' THEN 'friendly' WHEN 'gentle' THEN 'empathetic'
    WHEN 'intense' THEN CASE WHEN d THEN 'terrified' ELSE 'angry' END WHEN 'excited' THEN CASE WHEN d THEN 'excited' ELSE 'cheerful' END WHEN 'sad' THEN CASE WHEN d THEN 'empathetic' ELSE 'sad' END
    WHEN 'calm' THEN CASE WHEN d THEN 'gentle' ELSE 'calm' END END END AS style,
  CAST(round(1000 * greatest(0.6, least(1.9, e * 1.6))) AS BIGINT) AS degree_e3
FROM (SELECT doc_id, ['natural', 'Dramatic', 'conversational', 'gentle', 'intense', 'excited', 'sad', 'calm', 'odd'][1 + doc_id % 9] AS s0, lower(s0) AS s, CAST((doc_id % 13) / 12.0 AS DOUBLE) AS e, doc_id % 2 = 0 AS d FROM documents)""")
def q_express_style(spark, sf):
    names = F.array(*(F.lit(s) for s in ("natural", "Dramatic", "conversational", "gentle", "intense", "excited", "sad", "calm", "odd")))
    d = _t(spark, sf, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 9).cast("int")).alias("s"), ((F.col("doc_id") % 13) / 12.0).alias("e"))
    return d.select("doc_id", E.express_style(F.col("s"), F.col("doc_id") % 2 == 0, F.col("e")).alias("style"), F.round(1000 * E.wrapper_degree(F.col("e"))).cast("long").alias("degree_e3"))


@query("""SELECT doc_id, CASE WHEN w = 0 THEN 'whispering' WHEN w = 1 THEN 'angry' WHEN w = 2 THEN 'auto' ELSE 'sad' END AS style, CAST(round(1000 * least(0.96, e + CASE w WHEN 0 THEN 0.20 WHEN 1 THEN 0.13 WHEN 2 THEN 0.05 ELSE 0.09 END)) AS BIGINT) AS e3
FROM (SELECT doc_id, doc_id % 4 AS w, CAST((doc_id % 7) / 10.0 AS DOUBLE) AS e FROM documents)""")
def q_direction(spark, sf):
    """Voice directions: two keywords at once, a style, a boost without a style."""
    said = F.get(F.array(*(F.lit(s) for s in ("please be Whispering", "very ANGRY now", "a reflective tone", "so sad"))), (F.col("doc_id") % 4).cast("int"))
    led = E.direct(F.lit("auto"), (F.col("doc_id") % 7) / 10.0, said)
    return _t(spark, sf, "documents").select("doc_id", led.alias("d")).select("doc_id", "d.style", F.round(1000 * F.col("d.expressiveness")).cast("long").alias("e3"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'cheerful' WHEN 1 THEN 'natural' WHEN 2 THEN 'whispering' ELSE 'natural' END AS style, CAST(round(1000 * CASE doc_id % 4 WHEN 0 THEN least(0.96, e + 0.12) WHEN 2 THEN least(0.96, e + 0.03) ELSE e END) AS BIGINT) AS e3
FROM (SELECT doc_id, CAST((doc_id % 11) / 11.0 AS DOUBLE) AS e FROM documents)""")
def q_bias(spark, sf):
    said = F.get(F.array(F.lit(" Cheerful "), F.lit("unknown"), F.lit("whispering"), F.lit(None).cast("string")), (F.col("doc_id") % 4).cast("int"))
    led = E.biased(F.lit("natural"), (F.col("doc_id") % 11) / 11.0, said)
    return _t(spark, sf, "documents").select("doc_id", led.alias("d")).select("doc_id", "d.style", F.round(1000 * F.col("d.expressiveness")).cast("long").alias("e3"))


@query("""SELECT doc_id, format('{:+d}%', CAST(floor(greatest(-0.5, least(0.5, x)) * 100 + 0.5) AS BIGINT)) AS rate, CASE WHEN n = 0 THEN '+0Hz' ELSE format('{:+d}Hz', n) END AS pitch
FROM (SELECT doc_id, CAST(doc_id % 41 - 20 AS DOUBLE) / 16 AS x, doc_id % 9 - 4 AS n FROM documents)""")
def q_prosody_text(spark, sf):
    x, n = ((F.col("doc_id") % 41 - 20) / 16.0), (F.col("doc_id") % 9 - 4).cast("double")
    return _t(spark, sf, "documents").select("doc_id", E.percent(E.clamp(x, -0.5, 0.5)).alias("rate"), E.signed(n, "Hz").alias("pitch"))


@query("""SELECT conv_id, turn, '<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis" xmlns:mstts="http://www.w3.org/2001/mstts" xml:lang="en-US"><prosody rate="+10%" pitch="-2Hz" volume="+0%">' ||
  replace(replace(replace(replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</prosody></speak>' AS ssml FROM conversations""".replace("\\\\", "\\"))
def q_basic_markup(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", S.basic(F.col("text"), F.lit(0.1), F.lit(-2.0), F.lit(0.0)).alias("ssml"))


@query("""SELECT doc_id, CAST(floor(length(text) / 28.0) AS BIGINT) AS fast, CAST(floor(length(text) / 16.0) AS BIGINT) AS slow, CAST(round(1000 * greatest(1.0, least(8.0, length(text) / 55.0))) AS BIGINT) AS clip_ms FROM documents""")
def q_durations(spark, sf):
    n = F.length("text")
    return _t(spark, sf, "documents").select("doc_id", E.generation_seconds(n, F.lit("edge-tts")).alias("fast"), E.generation_seconds(n, F.lit("kokoro")).alias("slow"), F.round(1000 * E.mock_duration(F.col("text"))).cast("long").alias("clip_ms"))


@query("""SELECT o_orderkey, ['anull', 'atempo=2', 'atempo=2,atempo=2', 'atempo=0.5', 'atempo=0.5,atempo=0.5', 'atempo=1.25', 'atempo=2,atempo=1.5'][1 + o_orderkey % 7] AS chain FROM orders""")
def q_tempo_chain(spark, sf):
    speed = F.get(F.array(*(F.lit(x) for x in (1.0, 2.0, 4.0, 0.5, 0.25, 1.25, 3.0))), (F.col("o_orderkey") % 7).cast("int"))
    return _t(spark, sf, "orders").select("o_orderkey", E.tempo_filter(speed).alias("chain"))


@query(f"""SELECT doc_id, b.name AS name, b.style AS style, format('{{:.1f}}', greatest(0.4, least(1.9, b.factor * (0.6 + e * 0.85)))) AS degree
FROM (SELECT doc_id, list_max({_RULE_SQL}) AS b, CAST((doc_id % 10) / 10.0 AS DOUBLE) AS e FROM {_FELT_SQL}) WHERE b.n > 0 AND e >= 0.2""")
def q_detect_emotion(spark, sf):
    felt = E.detect_emotion(F.col("text"), (F.col("doc_id") % 10) / 10.0)
    return _felt(spark, sf).select("doc_id", F.explode(F.array(felt)).alias("f")).filter("f is not null").select("doc_id", "f.name", "f.style", "f.degree")


# ---- text, labels and messages --------------------------------------------------------------


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(translate(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '‘’“”', '''''""'), '…', '...'), '—', ' — '), '–', ' – '), '[\s\x{A0}\x{FEFF}]+', ' ', 'g'))) AS md5 FROM (SELECT doc_id, text || ' — “so” … ‘x’ – end' AS text FROM documents)""")
def q_clean_web(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.clean_web(F.concat("text", F.lit(" — “so” … ‘x’ – end")))).alias("md5"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text || ' <b> & "x" ''y''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS md5 FROM documents""")
def q_html_escape(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.html_escape(F.concat("text", F.lit(" <b> & \"x\" 'y'")))).alias("md5"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Input validation' WHEN 1 THEN 'Network timeout' WHEN 2 THEN 'System dependency' WHEN 3 THEN 'Network' WHEN 4 THEN 'Processing' ELSE 'Network timeout' END AS category,
  CASE event_id % 6 WHEN 0 THEN 'Verify the selected input source and try again.' WHEN 2 THEN 'Install/verify FFmpeg + ffprobe, then rerun preflight checks.' WHEN 3 THEN 'Check connectivity or switch to local/offline input.'
    WHEN 4 THEN 'Check logs and retry. If it persists, reduce input size.' ELSE 'Retry with a shorter text/input or a more stable connection.' END AS hint FROM events""")
def q_error_hints(spark, sf):
    k = (F.col("event_id") % 6).cast("int")
    said = F.get(F.array(*(F.lit(s) for s in ("bad", "it timed out", "ffprobe missing", "DNS failed", "odd", "odd"))), k)
    kind = F.get(F.array(*(F.lit(s) for s in ("ValueError", "", "", "", "", "TimeoutError"))), k)
    return _t(spark, sf, "events").select("event_id", X.error_class(said, kind).alias("c")).select("event_id", "c.category", "c.hint")


@query("""SELECT event_id, 'Issue in chapter ' || user_id || ', segment ' || event_id || ': ' || event_type AS bad, CASE WHEN event_id % 2 = 0 THEN 'Using cached audio' ELSE 'Generating audio' END AS other FROM events""")
def q_progress_errors(spark, sf):
    bad = F.concat(F.lit("Error on chapter "), "user_id", F.lit(", segment "), "event_id", F.lit(":  "), "event_type")
    other = F.when(F.col("event_id") % 2 == 0, "it is Already Cached here")
    return _t(spark, sf, "events").select("event_id", X.progress_message(bad).alias("bad"), X.progress_message(other).alias("other"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN '⚪ **Error**' WHEN 'click' THEN '🟣 **Generating** · click' ELSE '✅ **Completed** · ' || event_type END AS badge FROM events""")
def q_state_badge(spark, sf):
    state = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "Generating").otherwise("completed")
    return _t(spark, sf, "events").select("event_id", X.state_badge(state, F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("")).alias("badge"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'kokoro' ELSE 'edge-tts' END AS engine, CASE p_partkey % 3 WHEN 1 THEN 'post_process' ELSE 'native' END AS speed,
  ['regex_only', 'quotes_only', 'auto'][1 + p_partkey % 3] AS strategy, ['Regex only (faster)', 'Quotes only (fastest)', 'Auto (best quality)'][1 + p_partkey % 3] AS strategy_label,
  CASE p_partkey % 3 WHEN 2 THEN 'M4B (chapter bookmarks)' ELSE 'MP3 (single file, easiest to share)' END AS format FROM part""")
def q_labels(spark, sf):
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 3).cast("int"))
    way = pick("Regex only", "QUOTES first", "anything")
    return _t(spark, sf, "part").select(
        "p_partkey", X.engine_label(pick("Kokoro offline", "Edge", None)).alias("engine"), X.speed_mode(pick("native", "Post-process", "x")).alias("speed"), X.dialogue_strategy(way).alias("strategy"),
        X.dialogue_strategy_label(way).alias("strategy_label"), X.output_format_label(pick("mp3", "x m4b", " M4B file")).alias("format"),
    )


@query("""SELECT p_partkey, ['epub', 'pdf', 'docx', 'text', NULL, 'text', 'pdf', NULL, 'text'][1 + p_partkey % 9] AS kind FROM part""")
def q_file_kind(spark, sf):
    k = (F.col("p_partkey") % 9).cast("int")
    name = F.get(F.array(*(F.lit(n) for n in ("A.EPUB", "b.pdf", "c.docx", "d.md", "e.mobi", "noext", "x.bin", "g.Doc", "h"))), k)
    mime = F.when(k == 6, "application/pdf").when(k == 8, "text/html")
    return _t(spark, sf, "part").select("p_partkey", X.file_kind(name, mime).alias("kind"))


@query("""SELECT p_partkey, [true, false, false, false, true, false, false, false, true, false][1 + p_partkey % 10] AS safe FROM part""")
def q_url_safe(spark, sf):
    """Literal private hosts, other schemes and hosts that are not allowed are refused."""
    urls = ("https://example.org/x", "http://127.0.0.1/x", "http://10.2.3.4", "ftp://example.org", "http://EXAMPLE.org:80", "http://localhost:8", "https://user@192.168.1.1/", "http://[::1]/", "https://8.8.8.8/dns", "")
    return _t(spark, sf, "part").select("p_partkey", X.url_is_safe(F.get(F.array(*map(F.lit, urls)), (F.col("p_partkey") % 10).cast("int"))).alias("safe"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Mara Vale' WHEN 3 THEN 'Oren' END AS name, regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') || '_unknown_text' AS profile FROM customer""")
def q_names(spark, sf):
    raw = F.get(F.array(F.lit(" Mara Vale, "), F.lit("He"), F.lit("X"), F.lit("Oren—")), (F.col("c_custkey") % 4).cast("int"))
    return _t(spark, sf, "customer").select("c_custkey", X.clean_speaker(raw).alias("name"), X.profile_key(F.col("c_name"), F.lit(None), F.lit("")).alias("profile"))


@query("""SELECT c_custkey, md5('{"' || c_mktsegment || '": "' || c_nationkey || '", "a": "b"}') AS map_md5, substr(md5(c_name || '|' || c_nationkey), 1, 12) AS print FROM customer""")
def q_map_hash(spark, sf):
    m = F.create_map(F.lit("a"), F.lit("b"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return _t(spark, sf, "customer").select("c_custkey", H.map_hash(m).alias("map_md5"), H.fingerprint(F.col("c_name"), F.col("c_nationkey").cast("string")).alias("print"))


@query(r"""SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS md5 FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, """ + _BLANK + r""")), lambda x: x <> '') AS s FROM documents)""")
def q_sentences_py(spark, sf):
    s = X.sentences(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("md5"))


# ---- pages, previews, projects, cache -------------------------------------------------------


@query("SELECT lang AS locale, source, doc_id AS id FROM documents ORDER BY lang, doc_id LIMIT 12 OFFSET 24")
def q_voice_page(spark, sf):
    """The third page of a catalogue with as many rows as there are documents."""
    d = _t(spark, sf, "documents").select(F.col("lang").alias("locale"), "source", F.col("doc_id").alias("id"))
    return V.page(d, 2)


@query("""WITH s AS (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id)
SELECT conv_id, 'Talk ' || conv_id AS title, n AS segments, CASE WHEN length(t) > 160 THEN substr(t, 1, 157) || '...' ELSE t END AS snippet, greatest((SELECT count(*) FROM s) - 8, 0) AS more
FROM (SELECT conv_id, n, replace(trim(first), chr(10), ' ') AS t FROM s) ORDER BY conv_id LIMIT 8""")
def q_preview(spark, sf):
    c = _t(spark, sf, "conversations")
    chapters = c.select("conv_id").distinct().withColumn("title", F.concat(F.lit("Talk "), "conv_id"))
    return R.preview(chapters, c.select("conv_id", F.col("turn").alias("seg_idx"), "text"), ["conv_id"])


@query("""WITH m AS (SELECT user_id, ['parse', 'generate', 'assemble'][1 + event_id % 3] AS stage, value, event_id FROM events),
l AS (SELECT user_id, stage, arg_max(value, event_id) AS s FROM m GROUP BY 1, 2)
SELECT user_id AS project_id, max(s) FILTER (stage = 'parse') AS parse, max(s) FILTER (stage = 'generate') AS generate, max(s) FILTER (stage = 'assemble') AS assemble FROM l GROUP BY user_id""")
def q_stage_timings(spark, sf):
    stage = F.get(F.array(F.lit("parse"), F.lit("generate"), F.lit("assemble")), (F.col("event_id") % 3).cast("int"))
    return R.stage_timings(_t(spark, sf, "events").select(F.col("user_id").alias("project_id"), stage.alias("stage"), F.lit("seconds").alias("name"), "value", F.col("event_id").alias("ts")))


@query(f"""SELECT v.speaker, 'v_' || v.speaker AS voice, 'auto' AS detected_by, coalesce(n, 0) AS segments FROM (SELECT 'assistant' AS speaker UNION ALL SELECT 'nobody' UNION ALL SELECT 'user') v
LEFT JOIN (SELECT speaker, count(*) AS n FROM {_SEGS_SQL} WHERE speaker <> 'narrator' GROUP BY speaker) s USING (speaker)""")
def q_character_table(spark, sf):
    voices = spark.createDataFrame([(s, f"v_{s}", "auto") for s in ("user", "nobody", "assistant")], "speaker string, voice string, detected_by string")
    return R.character_table(voices, _segs(spark, sf))


@query(f"""SELECT bool_or(status = 'error' OR (status = 'cached' AND seg_idx > 5)) AS has_errors FROM {_SEGS_SQL}""")
def q_has_errors(spark, sf):
    segs = _segs(spark, sf)
    return R.has_errors(segs, segs.filter("seg_idx <= 5").select(F.col("cache_file").alias("path")))


@query("""SELECT 'p' || min(doc_id) AS id FROM documents WHERE doc_id % 7 = 3""")
def q_resume_choice(spark, sf):
    """The project whose manifest was used last, where the id used last is gone."""
    last = _t(spark, sf, "documents").filter("doc_id % 7 = 3").agg(F.min("doc_id")).first()[0]
    projects = _t(spark, sf, "documents").select(F.concat(F.lit("p"), "doc_id").alias("id"), F.concat(F.lit("m"), "doc_id").alias("manifest_path"))
    return P.resume_choice(projects, None, "gone", f"m{last}")


@query("""SELECT doc_id, '**Title:** ' || source || chr(10) || chr(10) || '**State:** parsed' || chr(10) || chr(10) || '**Storage:** local' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '**Manifest:** `m' || doc_id || '`' ELSE '' END AS markdown FROM documents""")
def q_project_markdown(spark, sf):
    blank = F.lit("")
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("parsed").alias("state"), F.lit("local").alias("storage"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("m"), "doc_id")).otherwise("").alias("manifest_path"), blank.alias("output_path"), blank.alias("cloud_url"))
    return P.project_markdown(d).withColumnRenamed("id", "doc_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'quota' WHEN 1 THEN 'quota' ELSE 'rate_limit' END AS reason, ['no more', 'Out of credits', 'slow down', 'HTTP 429'][1 + event_id % 4] AS detail FROM events""")
def q_provider_errors(spark, sf):
    bodies = ('{"detail": {"status": "quota_exceeded", "message": "no more"}}', '{"detail": "Out of credits"}', '{"message": "slow down"}', "not json")
    body = F.get(F.array(*map(F.lit, bodies)), (F.col("event_id") % 4).cast("int"))
    return _t(spark, sf, "events").select("event_id", P.quota_or_rate(body).alias("reason"), P.error_detail(body, "HTTP 429").alias("detail"))


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS done, CAST(round(1000 * (500 - row_number() OVER (PARTITION BY user_id ORDER BY event_id)) / (row_number() OVER (PARTITION BY user_id ORDER BY event_id) / CAST(10 + event_id % 50 AS DOUBLE))) AS BIGINT) AS eta_ms FROM events""")
def q_pace(spark, sf):
    e = P.eta_seconds(_t(spark, sf, "events"), ["user_id"], "event_id", (10 + F.col("event_id") % 50).cast("double"), F.lit(500))
    return e.select("user_id", "event_id", "done", F.round(1000 * F.col("eta")).cast("long").alias("eta_ms"))


@query("""SELECT round(sum(1 + event_id % 97) / 1048576.0, 9) AS size_mb, count(*) AS entries FROM events""")
def q_cache_size(spark, sf):
    c = C.size_and_count(_t(spark, sf, "events").select((1 + F.col("event_id") % 97).alias("size_bytes")))
    return c.select(F.round("size_mb", 9).alias("size_mb"), "entries")


@query("""SELECT user_id % 20 AS cache_key, max(event_id) AS filename FROM events GROUP BY 1""")
def q_cache_put(spark, sf):
    e = _t(spark, sf, "events").select((F.col("user_id") % 20).alias("cache_key"), F.col("event_id").alias("filename"), F.col("event_id").alias("created"))
    return C.put(e.filter("filename % 2 = 0"), e.filter("filename % 2 = 1")).select("cache_key", "filename")


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'n' WHEN role = 'user' THEN 'given' ELSE 'd' END AS voice, CASE WHEN (CASE WHEN role = 'system' THEN 'n' WHEN role = 'user' THEN 'given' ELSE 'd' END) <> 'd' THEN 'pending' ELSE 'cached' END AS status FROM conversations""")
def q_assign_voices(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "narrator").otherwise(F.col("role")).alias("speaker"), F.lit("d").alias("voice"), F.lit("cached").alias("status"))
    given = spark.createDataFrame([("user", "given"), ("assistant", "")], "speaker string, voice string")
    return V.assign_voices(c, given, "n", "d", auto=False).select("conv_id", "turn", "voice", "status")


@query("""SELECT c_custkey, ['whispering', 'sad', 'cheerful', NULL, NULL][1 + c_custkey % 5] AS style FROM customer""")
def q_resolve_style(spark, sf):
    want = F.get(F.array(*(F.lit(s) for s in ("Whisper", "sad", "excited", "natural", "angry"))), (F.col("c_custkey") % 5).cast("int"))
    has = F.array(F.lit("sad"), F.lit("cheerful"), F.lit("whispering"))
    return _t(spark, sf, "customer").select("c_custkey", V.resolve_style(has, want).alias("style"))


# ---- books ----------------------------------------------------------------------------------

_BOOK = """(SELECT conv_id, turn, '"' || replace(text, '"', '''') || '"' AS said, CASE role WHEN 'user' THEN 'Mara' ELSE 'Oren' END AS name, CASE WHEN turn % 3 = 2 THEN '' ELSE ' ' || CASE role WHEN 'user' THEN 'Mara' ELSE 'Oren' END || ' said.' END AS tail,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)"""
#: Spans as the book was put together: a quote starts where the paragraphs before end.
_SPANS = f"""t AS (SELECT *, coalesce(sum(length(said || tail) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, CASE WHEN tail <> '' THEN name END AS known FROM {_BOOK}),
w AS (
  SELECT conv_id, rn, known AS who, known AS x, CAST(NULL AS VARCHAR) AS y FROM t WHERE rn = 1
  UNION ALL
  SELECT n.conv_id, n.rn, coalesce(n.known, CASE WHEN w.x <> w.y THEN w.y END), coalesce(n.known, CASE WHEN w.x <> w.y THEN w.y END, w.x), CASE WHEN coalesce(n.known, CASE WHEN w.x <> w.y THEN w.y END) IS NULL THEN w.y ELSE w.x END
  FROM w JOIN t n ON n.conv_id = w.conv_id AND n.rn = w.rn + 1),
d AS (SELECT t.conv_id, t.rn, CAST(a AS INTEGER) AS "start", CAST(a + length(said) AS INTEGER) AS "end", w.who AS speaker,
  CASE WHEN known IS NOT NULL THEN 'regex' WHEN who IS NOT NULL THEN 'alternation' ELSE 'unattributed' END AS method, CASE WHEN known IS NOT NULL THEN 0.95 WHEN who IS NOT NULL THEN 0.55 ELSE 0.2 END AS confidence, said
  FROM t JOIN w ON w.conv_id = t.conv_id AND w.rn = t.rn)"""

SPANS_SQL = f"""WITH RECURSIVE {_SPANS}
SELECT conv_id, "start", "end", speaker, method, CAST(confidence AS DOUBLE) AS confidence, 'double' AS quote_style, md5(trim(substr(said, 2, length(said) - 2), {_BLANK})) AS md5 FROM d"""
REGEX_ONLY_SQL = f"""WITH RECURSIVE {_SPANS} SELECT d.conv_id, d."start", CAST(d."end" + length(d.speaker) + 6 AS INTEGER) AS "end", d.speaker, 'regex' AS method FROM d WHERE method = 'regex'"""

#: Segments: a paragraph is a turn; its sentences are packed, and found again from left to right.
_SEGMENTS = f"""p AS (SELECT conv_id, rn, said || tail AS par, coalesce(sum(length(said || tail) + 2) OVER (PARTITION BY conv_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {_BOOK}),
s AS (SELECT conv_id, rn, par, a, list_filter(list_transform(string_split(regexp_replace(trim(par, {_BLANK}), '([.!?])\\s+([A-Z"“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS q FROM p),
k AS (
  SELECT conv_id, rn, 1 AS i, CAST(0 AS BIGINT) AS chunk, CAST(length(q[1]) + 1 AS BIGINT) AS size FROM s WHERE length(par) > 400
  UNION ALL
  SELECT k.conv_id, k.rn, i + 1, CASE WHEN size + length(q[i + 1]) + 1 > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN size + length(q[i + 1]) + 1 > 400 THEN length(q[i + 1]) + 1 ELSE size + length(q[i + 1]) + 1 END
  FROM k JOIN s ON s.conv_id = k.conv_id AND s.rn = k.rn WHERE i < len(q)),
c AS (SELECT k.conv_id, k.rn, chunk, string_agg(q[i], ' ' ORDER BY i) AS txt FROM k JOIN s ON s.conv_id = k.conv_id AND s.rn = k.rn GROUP BY 1, 2, 3
  UNION ALL SELECT conv_id, rn, 0, trim(par, {_BLANK}) FROM s WHERE length(par) <= 400),
f AS (
  SELECT c.conv_id, c.rn, chunk, txt, CASE WHEN instr(par, txt) = 0 THEN CAST(0 AS BIGINT) ELSE instr(par, txt) - 1 END AS rel FROM c JOIN s ON s.conv_id = c.conv_id AND s.rn = c.rn WHERE chunk = 0
  UNION ALL
  SELECT c.conv_id, c.rn, c.chunk, c.txt, CASE WHEN instr(substr(par, f.rel + length(f.txt) + 1), c.txt) = 0 THEN f.rel + length(f.txt) ELSE f.rel + length(f.txt) + instr(substr(par, f.rel + length(f.txt) + 1), c.txt) - 1 END
  FROM f JOIN c ON c.conv_id = f.conv_id AND c.rn = f.rn AND c.chunk = f.chunk + 1 JOIN s ON s.conv_id = c.conv_id AND s.rn = c.rn),
g AS (SELECT f.conv_id, CAST(row_number() OVER (PARTITION BY f.conv_id ORDER BY f.rn, chunk) - 1 AS INTEGER) AS seg_idx, CAST(a + rel AS INTEGER) AS "start", CAST(a + rel + length(txt) AS INTEGER) AS "end", txt,
  chunk = max(chunk) OVER (PARTITION BY f.conv_id, f.rn) AS last FROM f JOIN s ON s.conv_id = f.conv_id AND s.rn = f.rn)"""

SEGMENTS_SQL = f"""WITH RECURSIVE {_SEGMENTS} SELECT conv_id, seg_idx, "start", "end", 0 AS epoch, last AS paragraph_break_after, false AS scene_break_after, md5(txt) AS md5 FROM g"""

ATTRIBUTED_SQL = f"""WITH RECURSIVE {_SPANS}, {_SEGMENTS},
j AS (SELECT g.conv_id, seg_idx, txt, arg_min(d.speaker, d."start") AS who, arg_min(d.method, d."start") AS how, arg_min(d.confidence, d."start") AS sure
  FROM g LEFT JOIN d ON d.conv_id = g.conv_id AND d.speaker IS NOT NULL AND g."start" < d."end" AND g."end" > d."start" GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seg_idx) AS n, regexp_matches(txt, '["“”]') AS ask FROM j),
v AS (
  SELECT conv_id, n, who AS said_by, who AS x, CAST(NULL AS VARCHAR) AS y FROM o WHERE n = 1
  UNION ALL
  SELECT o.conv_id, o.n, coalesce(o.who, CASE WHEN o.ask AND v.x <> v.y THEN v.y END), coalesce(o.who, CASE WHEN o.ask AND v.x <> v.y THEN v.y END, v.x), CASE WHEN coalesce(o.who, CASE WHEN o.ask AND v.x <> v.y THEN v.y END) IS NULL THEN v.y ELSE v.x END
  FROM v JOIN o ON o.conv_id = v.conv_id AND o.n = v.n + 1)
SELECT o.conv_id, o.seg_idx, coalesce(v.said_by, 'narrator') AS speaker, CASE WHEN o.who IS NOT NULL THEN o.how WHEN v.said_by IS NOT NULL THEN 'alternation_span' ELSE 'narration' END AS speaker_method,
  CAST(CASE WHEN o.who IS NOT NULL THEN o.sure WHEN v.said_by IS NOT NULL THEN 0.45 ELSE 0.2 END AS DOUBLE) AS speaker_confidence
FROM o JOIN v ON v.conv_id = o.conv_id AND v.n = o.n"""

_WHOLE = f"(SELECT conv_id, string_agg(said || tail, chr(10) || chr(10) ORDER BY turn) AS text FROM {_BOOK} GROUP BY conv_id)"
CHAPTERS_DESKTOP_SQL = f"""SELECT bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY conv_id) - 1 AS INTEGER) AS chapter_idx, CASE WHEN count(*) OVER (PARTITION BY bucket) < 2 THEN 'Chapter 1' ELSE 'Chapter ' || conv_id END AS title,
  md5(trim('Chapter ' || conv_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '{_NIGHT}', {_BLANK})) AS md5 FROM (SELECT conv_id % 10 AS bucket, conv_id, text FROM {_WHOLE})"""
CHAPTERS_WEB_SQL = rf"""SELECT bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY conv_id) - 1 AS INTEGER) AS chapter_idx, 'Chapter ' || (conv_id + 1) AS title,
  md5(trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANK})) AS md5 FROM (SELECT conv_id % 10 AS bucket, conv_id, text FROM {_WHOLE})"""


# ---- SQL of queries that have none in queries.py --------------------------------------------

_SPACES = r"[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\x0B]"


def _clean_sql() -> str:
    t = "text"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "''"), ("&quot;", '"')):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    for short, full in X.ABBREVIATIONS:
        edge = r"(?i)(^|[^\pL\pN\pM_])"  # a word's start, also after letters that are not ASCII
        t = rf"regexp_replace({t}, '{edge}St\.{_SPACES}+([A-Za-z])', '\1Saint \2', 'g')" if short == "St" else rf"regexp_replace({t}, '{edge}{short}\.', '\1{full}', 'g')"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '{_SPACES}*—{_SPACES}*', ', ', 'g'), '\\.\\.\\.+', '…', 'g'), '([!?]){{2,}}', '\\1', 'g')"
    words = r"list_transform(regexp_extract_all(t, '[\pL\pN\pM_]+|[^\pL\pN\pM_]+'), lambda x: CASE WHEN regexp_full_match(x, '[A-Z]{4,}') THEN substr(x, 1, 1) || lower(substr(x, 2)) ELSE x END)"
    return rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(array_to_string({words}, ''), '[*_`~#\\]', '', 'g'), '{_SPACES}+', ' ', 'g'))) AS md5 FROM (SELECT doc_id, {t} AS t FROM documents)"""


def _blocks_sql() -> str:
    gone = "|".join(["(?is)<!--.*?-->", r"<head\b.*?</head>", *(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "nav", "header", "footer"))])
    b = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{gone}', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|h[1-6]|blockquote|pre|tr)\s*>', chr(10) || chr(10), 'g'), '(?s)<[^>]+>', '', 'g')"
    for a, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        b = f"replace({b}, '{a}', '{c}')"
    b = rf"trim(regexp_replace(regexp_replace({b}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANK})"
    return f"SELECT page_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS md5 FROM (SELECT page_id, {b} AS t FROM pages)"


def _metadata_sql(times: str) -> str:
    nl = "chr(10)"
    head = f"';FFMETADATA1' || {nl} || 'title=Book ' || book || {nl} || 'artist=Unknown' || {nl} || 'album=Book ' || book || {nl} || 'genre=Audiobook' || {nl} || {nl}"
    block = f"'[CHAPTER]' || {nl} || 'TIMEBASE=1/1000' || {nl} || 'START=' || start_ms || {nl} || 'END=' || end_ms || {nl} || 'title=Talk ' || chapter || {nl}"
    return f"SELECT book, {head} || string_agg({block}, {nl} ORDER BY chapter) AS text FROM ({times}) GROUP BY book"


def oracles(known: dict[str, str]) -> dict[str, str]:
    """SQL by query for those that queries.py defines without."""
    return {
        "q_metadata_text": _metadata_sql(known["q_timeline"]), "q_clean_desktop": _clean_sql(), "q_html_blocks": _blocks_sql(), "q_dialogue_spans": SPANS_SQL, "q_dialogue_regex_only": REGEX_ONLY_SQL,
        "q_segments": SEGMENTS_SQL, "q_attributed_segments": ATTRIBUTED_SQL, "q_chapters_desktop": CHAPTERS_DESKTOP_SQL, "q_chapters_web": CHAPTERS_WEB_SQL,
    }


ORACLES.update(oracles(ORACLES))


# ---- rules, names and entries under hot keys ------------------------------------------------------


@query(f"""SELECT doc_id, r.name AS emotion, r.style AS style, CAST(r.n AS INTEGER) AS hits FROM (SELECT doc_id, unnest({_RULE_SQL}) AS r FROM {_FELT_SQL}) WHERE r.n > 0""")
def q_rules_by_table(spark, sf):
    """All rules of a table that each document matches, by one automaton."""
    from fablespark.functions.rules import rule_counts_by_table

    found = rule_counts_by_table(_felt(spark, sf).select("doc_id", "text"), E.rules_table(spark, "web"), ["doc_id"])
    return found.select("doc_id", F.col("name").alias("emotion"), "style", F.col("n").alias("hits"))


@query("""WITH c AS (SELECT conv_id, turn, text, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 2 AS s FROM conversations),
q AS (SELECT conv_id, turn, s AS a, s + length(text) AS b, turn % 4 = 3 AS named FROM c),
e AS (SELECT conv_id, turn AS t, s + (turn * 131) % (length(text) + 1) AS pos FROM c WHERE turn % 2 = 0),
n AS (SELECT q.conv_id, q.turn, e.t, row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY abs(pos - a), pos, 'Name' || t) AS k FROM q JOIN e ON e.conv_id = q.conv_id AND pos >= a - 500 AND pos < b + 500 WHERE NOT named)
SELECT q.conv_id, q.turn, 'Name' || n.t AS entity FROM q LEFT JOIN n ON n.conv_id = q.conv_id AND n.turn = q.turn AND n.k = 1""")
def q_nearest_entity(spark, sf):
    """Turns laid end to end as quotes of a conversation, with a name in every second turn."""
    from pyspark.sql import Window

    before = F.sum(F.length("text") + 2).over(Window.partitionBy("conv_id").orderBy("turn")) - F.length("text") - 2
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "text", before.alias("s"))
    quotes = c.select("conv_id", F.col("turn").alias("ord"), F.struct(F.col("s").alias("start"), (F.col("s") + F.length("text")).alias("end")).alias("q"), F.when(F.col("turn") % 4 == 3, "Known").alias("named"))
    names = c.filter("turn % 2 = 0").select("conv_id", F.concat(F.lit("Name"), "turn").alias("name"), (F.col("s") + (F.col("turn") * 131) % (F.length("text") + 1)).alias("position"))
    return D.nearest_entity(quotes, names, ["conv_id"]).select("conv_id", F.col("ord").alias("turn"), "entity")


@query("""SELECT k AS cache_key, arg_max(f, (t, f)) AS filename, CAST(max(t) AS BIGINT) AS created FROM (
  SELECT user_id AS k, 'old' || event_id AS f, event_id AS t FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, 'new' || event_id, event_id FROM events WHERE event_id % 3 = 0 AND user_id % 8 = 1) GROUP BY k""")
def q_cache_upsert(spark, sf):
    """A cache table written by partitions, then a second set of entries put into the partitions that they touch."""
    import uuid

    e = _t(spark, sf, "events").select(F.col("user_id").alias("cache_key"), "event_id", F.col("event_id").alias("created"))
    root = (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints").rstrip("/")
    path = f"{root}/fablespark/upsert-{uuid.uuid4().hex}"
    row = lambda name: ("cache_key", F.concat(F.lit(name), "event_id").alias("filename"), "created")
    C.upsert(spark, path, e.filter("event_id % 3 <> 0").select(*row("old")), 16)
    C.upsert(spark, path, e.filter("event_id % 3 = 0 and cache_key % 8 = 1").select(*row("new")))
    return C.stored(spark, path).select("cache_key", "filename", "created")


# ---- files --------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, 'Chapter 1' AS title, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[^\x00-\xFF]', '?', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS md5
FROM documents""")
def q_pdf_text(spark, sf):
    """Documents written as PDF files of one page, a shown string for each line, and read back as chapters."""
    from fablespark.sources.pdf import read_pdf

    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"([\\()])", r"\\$1")
    content = F.concat(F.lit("BT /R 10 Tf 12 TL 50 780 Td ("), F.replace(safe, F.lit("\n"), F.lit(") Tj T* (")), F.lit(") Tj ET"))
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /MediaBox [0 0 600 800] >> endobj\n"
    head += "3 0 obj << /Contents 5 0 R /Resources << /Font << /R 4 0 R >> >> >> endobj\n4 0 obj << /BaseFont /Courier /Encoding /WinAnsiEncoding >> endobj\n5 0 obj << >>\nstream\n"
    whole = F.concat(F.lit(head), content, F.lit("\nendstream endobj\ntrailer << /Root 1 0 R >>"))
    files = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.regexp_replace(whole, "[^\\x00-\\xFF]", "?"), "ISO-8859-1").alias("content"))
    return read_pdf(files).select(F.col("path").cast("long").alias("doc_id"), "title", F.md5("text").alias("md5"))


# ---- deep pages, open JSON, scene breaks -----------------------------------------------------------


@query("""SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS k, count(*) OVER () AS n FROM lineitem)
WHERE k // 12 = least(4999, (n - 1) // 12)""")
def q_deep_page(spark, sf):
    """Page 4999 of all line items by date, or the last one, without sorting the table."""
    from fablespark.operators import paging

    items = _t(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return paging.page(items, ["l_shipdate", "l_orderkey", "l_linenumber"], 4999, small=10_000)


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, len(json_keys(props)) + 2 AS n_keys, value AS nested FROM events WHERE json_valid(props)""")
def q_open_json(spark, sf):
    """Properties of events with keys put in; those that no schema knows stay."""
    from fablespark.sources.readers import open_map, put_keys

    e = _t(spark, sf, "events")
    put = put_keys(F.col("props"), {"kind": F.col("event_type"), "more": F.struct(F.col("value").alias("v"))})
    back = e.filter(F.try_parse_json("props").isNotNull()).select("event_id", open_map(put).alias("m"))
    get = lambda key, path, kind: F.try_variant_get(F.col("m")[key], path, kind)
    return back.select("event_id", get("k", "$", "long").alias("k"), get("kind", "$", "string").alias("kind"), F.size("m").cast("long").alias("n_keys"), get("more", "$.v", "double").alias("nested"))


_GAP = "CASE WHEN turn % 5 = 4 THEN chr(10) || chr(10) || ['***', '-----', '#'][1 + CAST(turn // 5 % 3 AS INTEGER)] || chr(10) || chr(10) WHEN turn % 5 = 2 THEN repeat(chr(10), 4) ELSE chr(10) || chr(10) END"


@query(f"""WITH t AS (SELECT conv_id, turn, 'Turn ' || turn || ': ' || regexp_replace(coalesce(text, ''), '\\s', ' ', 'g') || '.' AS body, {_GAP} AS gap FROM conversations),
s AS (SELECT *, coalesce(sum(length(body) + length(gap)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS final,
  coalesce(sum(CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM t)
SELECT conv_id, CAST(k - 1 AS INTEGER) AS seg_idx, CAST(a AS INTEGER) AS start, CAST(a + length(body) AS INTEGER) AS "end", CAST(epoch AS INTEGER) AS epoch, true AS paragraph_break_after,
  NOT final AND turn % 5 IN (2, 4) AS scene_break_after, md5(body) AS md5 FROM s""")
def q_scene_segments(spark, sf):
    """Turns as paragraphs, with separators and wide gaps between some: breaks, epochs and offsets of segments."""
    turn = F.col("turn")
    mark = F.get(F.array(F.lit("***"), F.lit("-----"), F.lit("#")), (F.floor(turn / 5) % 3).cast("int"))
    gap = F.when(turn % 5 == 4, F.concat(F.lit("\n\n"), mark, F.lit("\n\n"))).when(turn % 5 == 2, F.lit("\n" * 4)).otherwise(F.lit("\n\n"))
    body = F.concat(F.lit("Turn "), turn.cast("string"), F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", " "), F.lit("."))
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", body.alias("b"), gap.alias("g")))).alias("all"))
    last = F.size("all") - 1
    text = F.array_join(F.transform("all", lambda x, i: F.when(i == last, x["b"]).otherwise(F.concat(x["b"], x["g"]))), "")
    segs = CH.segments(c.select("conv_id", text.alias("text")), ["conv_id"], 100_000)
    return segs.select("conv_id", "seg_idx", "start", "end", "epoch", "paragraph_break_after", "scene_break_after", F.md5("text").alias("md5"))
