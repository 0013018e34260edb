"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
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
from fablespark.sources.readers import pages_to_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW_MS = 1_700_000_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# SQL fragments shared by several oracles
_NORM = r"""trim(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""
_RULE_SQL = "[" + ", ".join(f"{{'n': len(regexp_extract_all(text, '(?i){p}')), 'first': {-i}, 'name': '{n}', 'style': '{s}', 'factor': CAST({f} AS DOUBLE)}}" for i, (n, p, s, f) in enumerate(E.RULES_WEB)) + "]"


# The invented prose holds none of the rules' words, so emotion queries end each text with a few.
_FELT = ["the grief and tears", "a furious rage", "joy", "they whispered softly", "dread", "she laughed", "gently", "bliss and rapture", "betrayal", "nothing"]
_FELT_SQL = "(SELECT * REPLACE (text || ' ' || [" + ", ".join(f"'{w}'" for w in _FELT) + "][1 + doc_id % 10] AS text) FROM documents)"


def _felt(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, _FELT)), (1 + F.col("doc_id") % 10).cast("int"))
    return _t(spark, sf, "documents").withColumn("text", F.concat_ws(" ", "text", tail))


# ---- text and segmentation ------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_NORM}) AS text_md5, CAST(length({_NORM}) AS INTEGER) AS n FROM documents")
def q_normalize(spark, sf):
    t = X.normalize_text(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.md5(t).alias("text_md5"), F.length(t).alias("n"))


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CAST(length(l[i]) AS INTEGER) AS n, CAST(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)) AS BIGINT) AS start
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""".replace("CAST(list_sum", "CAST(coalesce(list_sum").replace("+ 1)) AS BIGINT", "+ 1)), 0) AS BIGINT"))
def q_lines_offsets(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", "line_no", F.length("line").alias("n"), F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long").alias("start"))


@query(r"""SELECT doc_id, CAST(len(s) AS INTEGER) AS n, CAST(list_max(list_transform(s, lambda x: length(x))) AS INTEGER) AS longest
FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS s FROM documents)""")
def q_sentences(spark, sf):
    s = F.regexp_extract_all("text", F.lit("([^.!?]+[.!?]*)"), 1)
    return _t(spark, sf, "documents").select("doc_id", F.size(s).alias("n"), F.array_max(F.transform(s, F.length)).alias("longest"))


_PACK = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_filter(list_transform(string_split(replace(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\s+([A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(2), ''), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p, text FROM documents),
w AS (
  SELECT doc_id, p, 1 AS i, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS size FROM s WHERE false
  UNION ALL
  SELECT doc_id, p, 1, CAST(0 AS BIGINT), CAST(length(p[1]) + 1 AS BIGINT) FROM s WHERE length(text) > 1500 AND len(p) > 0
  UNION ALL
  SELECT doc_id, p, i + 1, CASE WHEN size + length(p[i + 1]) + 1 > 1500 THEN chunk + 1 ELSE chunk END,
         CASE WHEN size + length(p[i + 1]) + 1 > 1500 THEN length(p[i + 1]) + 1 ELSE size + length(p[i + 1]) + 1 END
  FROM w WHERE i < len(p)),
c AS (SELECT doc_id, chunk, max(size) - 1 AS n FROM w GROUP BY doc_id, chunk)
SELECT doc_id, chunk, n FROM c
UNION ALL SELECT doc_id, 0, CAST(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS BIGINT) FROM documents WHERE length(text) <= 1500
"""


@query(_PACK)
def q_pack(spark, sf):
    """Chunk lengths of greedy packing."""
    packed = CH.pack_sentences(F.col("text"), 1500)
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(packed).alias("chunk", "t")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("t").cast("long").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
m AS (SELECT doc_id, i, length(line) < 40 AS cut FROM l),
g AS (SELECT doc_id, cut, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS epoch FROM m)
SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, count(*) AS lines FROM g WHERE NOT cut GROUP BY doc_id, epoch""")
def q_scene_islands(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.withColumn("cut", F.length("line") < 40)
    epoch = F.sum(F.col("cut").cast("int")).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.withColumn("epoch", epoch).filter(~F.col("cut")).groupBy("doc_id", "epoch").agg(F.count(F.lit(1)).alias("lines"))


@query()
def q_chunk_web(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(CH.chunk_web(F.col("text"), 900)).alias("chunk", "text")).select("doc_id", "chunk", F.length("text").alias("n"), F.md5("text").alias("md5"))


def _book(spark, sf) -> DataFrame:
    """Conversations as narrated chapters: turns quoted and attributed, so that the operators have work."""
    c = _t(spark, sf, "conversations")
    name = F.when(F.col("role") == "user", "Mara").otherwise("Oren")
    said = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit("'")), F.lit('" '), name, F.lit(" said."))
    line = F.when(F.col("turn") % 3 == 2, F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(said)
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("all"))
    return turns.select("conv_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n\n").alias("text"))


_NIGHT = "and so the night went on, " * 9 + "until it ended."  # longer than the least distance of headings


@query()
def q_chapters_desktop(spark, sf):
    book = _book(spark, sf).withColumn("bucket", (F.col("conv_id") % 10).cast("long"))
    body = F.concat(F.lit("Chapter "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n\n" + _NIGHT))
    texts = book.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("conv_id", body.alias("b")))).alias("all")).select("bucket", F.array_join(F.transform("all", lambda x: x["b"]), "\n\n").alias("text"))
    return CH.split_chapters(texts).select("bucket", "chapter_idx", "title", F.md5("text").alias("md5"))


@query()
def q_chapters_web(spark, sf):
    book = _book(spark, sf).withColumn("bucket", (F.col("conv_id") % 10).cast("long"))
    body = F.concat(F.lit("Chapter "), (F.col("conv_id") + 1).cast("string"), F.lit("\n\n"), F.col("text"))
    texts = book.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("conv_id", body.alias("b")))).alias("all")).select("bucket", F.array_join(F.transform("all", lambda x: x["b"]), "\n\n").alias("text"))
    return CH.split_chapters_web(texts).select("bucket", "chapter_idx", "title", F.md5("text").alias("md5"))


@query()
def q_segments(spark, sf):
    segs = CH.segments(_book(spark, sf), ["conv_id"], 400)
    return segs.select("conv_id", "seg_idx", "start", "end", "epoch", "paragraph_break_after", "scene_break_after", F.md5("text").alias("md5"))


# ---- emotion --------------------------------------------------------------------------------


@query(f"""SELECT doc_id, b.name AS emotion, b.style AS style, CAST(b.n AS INTEGER) AS hits FROM (SELECT doc_id, list_max({_RULE_SQL}) AS b FROM {_FELT_SQL}) WHERE b.n > 0""")
def q_emotion_best(spark, sf):
    best = F.explode(F.array(F.array_max(E.rule_counts(F.col("text")))))  # a generator, so that the filter does not count again
    return _felt(spark, sf).select("doc_id", best.alias("b")).filter("b.n > 0").select("doc_id", F.col("b.name").alias("emotion"), F.col("b.style").alias("style"), F.col("b.n").alias("hits"))


@query(f"""SELECT doc_id, CAST(round(greatest(0.4, least(1.9, b.factor * (0.6 + (doc_id % 10) / 10.0 * 0.85))) * 10000) AS BIGINT) AS degree_e4
FROM (SELECT doc_id, list_max({_RULE_SQL}) AS b FROM {_FELT_SQL}) WHERE b.n > 0""")
def q_emotion_degree(spark, sf):
    e = (F.col("doc_id") % 10) / 10.0
    best = F.explode(F.array(F.array_max(E.rule_counts(F.col("text")))))
    docs = _felt(spark, sf).select("doc_id", best.alias("b"), e.alias("e")).filter("b.n > 0")
    degree = F.greatest(F.lit(0.4), F.least(F.lit(1.9), F.col("b.factor") * (0.6 + F.col("e") * 0.85)))
    return docs.select("doc_id", F.round(degree * 10000).cast("long").alias("degree_e4"))


def _auto_sql() -> str:
    low = "lower(coalesce(text, ''))"
    case = " ".join(f"WHEN {' OR '.join('contains(' + low + ', ' + chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) + ')' for w in words)} THEN '{s}'" for s, words in E.CUES)
    return f"""SELECT doc_id, CASE WHEN calls > 1 THEN 'excited' WHEN asks AND cue = 'natural' THEN 'conversational' ELSE cue END AS style,
  CAST(round(100 * least(0.3, CASE WHEN cue <> 'natural' THEN 0.15 ELSE 0 END + CASE WHEN calls > 1 THEN 0.1 ELSE 0 END)) AS BIGINT) AS boost_e2
FROM (SELECT doc_id, CASE {case} ELSE 'natural' END AS cue, length({low}) - length(replace({low}, '!', '')) AS calls, contains({low}, '?') AS asks FROM documents)"""


@query(_auto_sql())
def q_auto_style(spark, sf):
    a = E.auto_style(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", a["style"].alias("style"), F.round(100 * a["boost"]).cast("long").alias("boost_e2"))


@query(f"""SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (b.n > 0) AS emotional, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS hits
FROM (SELECT lang, n_chars, list_max({_RULE_SQL}) AS b FROM {_FELT_SQL}) GROUP BY lang""")
def q_entry(spark, sf):
    """Documents, characters and emotion by language: scan, rules, aggregation."""
    best = F.array_max(E.rule_counts(F.col("text")))["n"]
    docs = _felt(spark, sf).select("lang", "n_chars", best.alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n") > 0).alias("emotional"), F.sum("n").alias("hits"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '!')) AS INTEGER) AS calls, CAST(len(regexp_extract_all(text, '[?]')) AS INTEGER) AS asks FROM documents")
def q_marks(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("!")).alias("calls"), F.regexp_count("text", F.lit("[?]")).alias("asks"))


@query("""SELECT doc_id, quality, toxic,
  round(CASE WHEN e >= 0.82 THEN greatest(0.05, s - 0.18) WHEN e >= 0.68 THEN greatest(0.08, s - 0.10) WHEN e >= 0.5 THEN greatest(0.12, s - 0.04) ELSE s END, 2) AS stability
FROM (SELECT doc_id, quality, toxic, e, CASE toxic WHEN 1 THEN greatest(0.12, s0 - 0.08) ELSE least(0.88, s0 + 0.08) END AS s FROM
  (SELECT doc_id, quality, toxic, e, greatest(0.18, least(0.92, 0.78 - e * 0.58)) AS s0 FROM (SELECT doc_id, quality, toxic, CAST((doc_id % 9 + 1) / 10.0 AS DOUBLE) AS e FROM labels)))""")
def q_provider_settings(spark, sf):
    e = ((F.col("doc_id") % 9 + 1) / 10.0).cast("double")
    style = F.when(F.col("toxic") == 1, "dramatic").otherwise("calm")
    return _t(spark, sf, "labels").select("doc_id", "quality", "toxic", E.provider_settings(style, e)["stability"].alias("stability"))


# ---- dialogue -------------------------------------------------------------------------------


@query()
def q_dialogue_spans(spark, sf):
    return D.detect_dialogue(_book(spark, sf), ["conv_id"]).select("conv_id", "start", "end", "speaker", "method", "confidence", "quote_style", F.md5("dialogue").alias("md5"))


@query()
def q_dialogue_regex_only(spark, sf):
    return D.detect_dialogue(_book(spark, sf), ["conv_id"], "regex_only").select("conv_id", "start", "end", "speaker", "method")


@query()
def q_attributed_segments(spark, sf):
    book = _book(spark, sf)
    out = D.attribute_segments(CH.segments(book, ["conv_id"], 400), D.detect_dialogue(book, ["conv_id"]), ["conv_id"])
    return out.select("conv_id", "seg_idx", "speaker", "speaker_method", "speaker_confidence")


@query()
def q_web_chunks(spark, sf):
    return D.chunks_web(_book(spark, sf), ["conv_id"]).select("conv_id", "index", "is_dialogue", "speaker", F.length("text").alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, turn * 100 AS a, turn * 100 + 60 AS b FROM conversations),
d AS (SELECT conv_id, turn * 80 AS a, turn * 80 + 50 AS b, role FROM conversations),
j AS (SELECT s.conv_id, s.turn, d.a, d.role FROM s LEFT JOIN d ON s.conv_id = d.conv_id AND s.a < d.b AND s.b > d.a)
SELECT conv_id, turn, arg_min(role, a) AS role FROM j GROUP BY conv_id, turn""")
def q_interval_first(spark, sf):
    c = _t(spark, sf, "conversations")
    left = c.select("conv_id", "turn", (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + 60).alias("end"))
    right = c.select("conv_id", (F.col("turn") * 80).alias("start"), (F.col("turn") * 80 + 50).alias("end"), "role")
    return D.interval_first(left, right, ["conv_id"], ["role"], 256).select("conv_id", "turn", "role")


@query("""SELECT s.conv_id, s.turn FROM conversations s WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = s.conv_id AND abs(b.turn * 7 - (s.turn * 5 + 2)) < 4)""")
def q_band_semi(spark, sf):
    c = _t(spark, sf, "conversations")
    b = c.select(F.col("conv_id").alias("k"), (F.col("turn") * 7).alias("p"))
    return c.join(b, (F.col("conv_id") == F.col("k")) & (F.abs(F.col("p") - (F.col("turn") * 5 + 2)) < 4), "left_semi").select("conv_id", "turn")


_TURNS = "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE role END AS speaker, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations"


@query(f"""WITH RECURSIVE t AS ({_TURNS}),
w AS (
  SELECT conv_id, turn, rn, speaker AS who, speaker AS a, CAST(NULL AS VARCHAR) AS b FROM t WHERE rn = 1
  UNION ALL
  SELECT n.conv_id, n.turn, n.rn, coalesce(n.speaker, CASE WHEN w.a <> w.b THEN w.b END),
    coalesce(n.speaker, CASE WHEN w.a <> w.b THEN w.b END, w.a), CASE WHEN coalesce(n.speaker, CASE WHEN w.a <> w.b THEN w.b END) IS NULL THEN w.b ELSE w.a END
  FROM w JOIN t n ON n.conv_id = w.conv_id AND n.rn = w.rn + 1)
SELECT conv_id, turn, who AS speaker FROM w""")
def q_alternation(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("speaker", F.when(F.col("turn") % 3 != 2, F.col("role")))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker"))).alias("all"))
    who = D.alternate(F.transform("all", lambda t: F.struct(t["speaker"].alias("speaker"), F.lit(True).alias("ask"))))
    return rows.select("conv_id", F.explode(F.arrays_zip(F.col("all").alias("t"), who.alias("w"))).alias("z")).select("conv_id", F.col("z")["t"]["turn"].alias("turn"), F.col("z")["w"].alias("speaker"))


@query("""SELECT role AS name, count(*) AS count FROM conversations GROUP BY role""")
def q_speaker_counts(spark, sf):
    return D.speaker_counts(_t(spark, sf, "conversations").withColumnRenamed("role", "speaker"), ["conv_id", "turn"])


@query("""WITH RECURSIVE t AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
w AS (SELECT conv_id, rn, role, CAST(n AS BIGINT) AS size, CAST(0 AS BIGINT) AS g FROM t WHERE rn = 1
  UNION ALL SELECT t.conv_id, t.rn, t.role, CASE WHEN t.role = w.role AND w.size + t.n + 1 <= 280 THEN w.size + t.n + 1 ELSE t.n END,
    CASE WHEN t.role = w.role AND w.size + t.n + 1 <= 280 THEN w.g ELSE w.g + 1 END FROM w JOIN t ON t.conv_id = w.conv_id AND t.rn = w.rn + 1)
SELECT conv_id, g AS idx, max(size) AS n FROM w GROUP BY conv_id, g""")
def q_merge_turns(spark, sf):
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    chunks = F.transform("all", lambda t: F.struct(t["text"].alias("text"), F.lit(True).alias("is_dialogue"), t["role"].alias("speaker")))
    return rows.select("conv_id", F.posexplode(D.merge_tiny(chunks)).alias("i", "c")).select("conv_id", F.col("i").cast("long").alias("idx"), F.length("c.text").cast("long").alias("n"))


# ---- reports --------------------------------------------------------------------------------


def _segs(spark, sf) -> DataFrame:
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", F.col("turn").alias("seg_idx"), F.when(F.col("role") == "system", "narrator").otherwise(F.col("role")).alias("speaker"), F.when((F.col("conv_id") + F.col("turn")) % 4 != 0, "cached").otherwise("pending").alias("status"),
                    E.mock_duration(F.col("text")).alias("duration_seconds"), (F.col("turn") % 2 == 0).alias("paragraph_break_after"), (F.col("turn") % 5 == 4).alias("scene_break_after"), F.concat_ws("_", F.lit("clip"), "conv_id", "turn").alias("cache_file"), "text")


_SEGS_SQL = """(SELECT conv_id, turn AS seg_idx, CASE role WHEN 'system' THEN 'narrator' ELSE role END AS speaker, CASE WHEN (conv_id + turn) % 4 <> 0 THEN 'cached' ELSE 'pending' END AS status,
 greatest(1.0, least(8.0, length(text) / CAST(55.0 AS DOUBLE))) AS duration_seconds, turn % 2 = 0 AS paragraph_break_after, turn % 5 = 4 AS scene_break_after, 'clip_' || conv_id || '_' || turn AS cache_file, text FROM conversations)"""


@query(f"""SELECT conv_id, count(*) AS segments, count(DISTINCT CASE WHEN speaker <> 'narrator' THEN speaker END) AS characters, count(*) FILTER (status = 'cached') AS cached,
 count(*) FILTER (status = 'cached') || '/' || count(*) AS done FROM {_SEGS_SQL} GROUP BY conv_id""")
def q_chapter_report(spark, sf):
    return R.chapter_table(_segs(spark, sf), ["conv_id"])


@query(f"""WITH k AS (SELECT DISTINCT conv_id FROM conversations UNION SELECT -1), s AS (SELECT conv_id, count(*) AS total, count(*) FILTER (status = 'cached') AS done, bool_and(status = 'cached') AS a FROM {_SEGS_SQL} GROUP BY conv_id)
SELECT conv_id, coalesce(done, 0) AS done, coalesce(total, 0) AS total, CAST(CASE WHEN coalesce(total, 0) = 0 THEN 0 ELSE round_even(100 * done / total, 0) END AS BIGINT) AS percent, CASE WHEN coalesce(a, true) THEN 'complete' ELSE 'pending' END AS status
FROM k LEFT JOIN s USING (conv_id)""")
def q_chapter_progress(spark, sf):
    segs = _segs(spark, sf)
    return R.chapter_progress(segs.select("conv_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"))), segs, ["conv_id"])


_MS = "CAST(floor(duration_seconds * 1000) AS BIGINT) + CASE WHEN scene_break_after THEN 1000 WHEN paragraph_break_after THEN 500 ELSE 0 END + CASE WHEN speaker <> 'narrator' THEN 300 ELSE 0 END"


@query(f"""WITH c AS (SELECT conv_id % 7 AS book, conv_id AS chapter, sum({_MS}) AS ms FROM {_SEGS_SQL} GROUP BY 1, 2),
g AS (SELECT book, chapter, ms + CASE WHEN lead(chapter) OVER (PARTITION BY book ORDER BY chapter) IS NOT NULL THEN 2000 ELSE 0 END AS ms FROM c)
SELECT book, chapter, CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM g WINDOW w AS (PARTITION BY book ORDER BY chapter)""")
def q_timeline(spark, sf):
    segs = _segs(spark, sf).withColumn("book", F.col("conv_id") % 7).withColumnRenamed("conv_id", "chapter")
    return R.timeline(segs, ["book"], "chapter")


@query(f"""WITH s AS (SELECT conv_id % 7 AS book, conv_id AS chapter, seg_idx, cache_file, speaker, scene_break_after, paragraph_break_after, lead(conv_id) OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, seg_idx) AS nxt FROM {_SEGS_SQL})
SELECT book, chapter, seg_idx, k, file FROM (
  SELECT book, chapter, seg_idx, 0 AS k, cache_file AS file FROM s
  UNION ALL SELECT book, chapter, seg_idx, 1, 'silence_03s' FROM s WHERE speaker <> 'narrator'
  UNION ALL SELECT book, chapter, seg_idx, 2, 'silence_1s' FROM s WHERE scene_break_after
  UNION ALL SELECT book, chapter, seg_idx, 3, 'silence_05s' FROM s WHERE NOT scene_break_after AND paragraph_break_after
  UNION ALL SELECT book, chapter, seg_idx, 4, 'silence_2s' FROM s WHERE nxt IS NOT NULL AND nxt <> chapter)""")
def q_playlist(spark, sf):
    segs = _segs(spark, sf).withColumn("book", F.col("conv_id") % 7).withColumnRenamed("conv_id", "chapter")
    return R.playlist(segs, ["book"], "chapter")


@query()
def q_metadata_text(spark, sf):
    segs = _segs(spark, sf).withColumn("book", F.col("conv_id") % 7).withColumnRenamed("conv_id", "chapter")
    titles = segs.select("book", "chapter").distinct().select("book", "chapter", F.concat_ws(" ", F.lit("Talk"), "chapter").alias("title"), F.concat_ws(" ", F.lit("Book"), "book").alias("book_title"), F.lit(None).cast("string").alias("author"))
    return R.metadata_text(R.timeline(segs, ["book"], "chapter"), titles, ["book"], "chapter")


@query(f"""SELECT speaker, count(*) AS n, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (status = 'cached') / count(*), 4) END AS rate FROM {_SEGS_SQL} GROUP BY speaker""")
def q_hit_rate(spark, sf):
    s = _segs(spark, sf).groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "cached").alias("hits"))
    return s.select("speaker", "n", R.hit_rate(F.col("hits"), F.col("n")).alias("rate"))


@query("""SELECT conv_id, turn, speaker, sample FROM (SELECT conv_id, turn, role AS speaker, CASE WHEN length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END AS sample FROM (SELECT conv_id, turn, role, replace(trim(text), chr(10), ' ') AS t FROM conversations WHERE role <> 'system')) ORDER BY conv_id, turn LIMIT 16""")
def q_dialogue_review(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("speaker", F.when(F.col("role") == "system", "narrator").otherwise(F.col("role"))).withColumn("speaker_method", F.lit("regex")).withColumn("speaker_confidence", F.lit(0.95))
    return R.dialogue_review(c, ["conv_id", "turn"]).select("conv_id", "turn", "speaker", "sample")


@query("""SELECT doc_id, snippet FROM (SELECT doc_id, CASE WHEN length(t) > 160 THEN substr(t, 1, 157) || '...' ELSE t END AS snippet FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)) ORDER BY doc_id LIMIT 8""")
def q_preview_topk(spark, sf):
    t = F.replace("text", F.lit("\n"), F.lit(" "))
    return _t(spark, sf, "documents").orderBy("doc_id").limit(8).select("doc_id", X.truncate(t, 160).alias("snippet"))


@query("SELECT lang, source, doc_id FROM documents ORDER BY lang, source, doc_id LIMIT 12 OFFSET 24")
def q_page(spark, sf):
    return _t(spark, sf, "documents").orderBy("lang", "source", "doc_id").offset(24).limit(12).select("lang", "source", "doc_id")


@query("""SELECT lang, source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) // 28) AS BIGINT) AS seconds FROM documents GROUP BY lang, source""")
def q_longform_stats(spark, sf):
    d = _t(spark, sf, "documents")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum(E.generation_seconds(F.length("text"), F.lit("edge-tts"))).alias("seconds"))


@query("""SELECT event_type AS stage, arg_max(value, ts) AS seconds FROM events GROUP BY event_type""")
def q_stage_latest(spark, sf):
    return _t(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.max_by("value", "ts").alias("seconds"))


@query("""SELECT user_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS state FROM events GROUP BY user_id""")
def q_run_state(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("state"), F.lit("").alias("message"), F.struct("ts", "event_id").alias("updated_at"))
    return R.run_state(e).select(F.col("project_id").alias("user_id"), "state")


# ---- voices, markup, hashes -----------------------------------------------------------------


@query(f"""SELECT c_custkey, [{', '.join(chr(39) + v + chr(39) for v in V.CHARACTER_POOL)}][1 + CAST((
  CAST('0x' || substr(md5(c_name), 1, 8) AS UBIGINT) * 4 + CAST('0x' || substr(md5(c_name), 9, 8) AS UBIGINT) * 4 + CAST('0x' || substr(md5(c_name), 17, 8) AS UBIGINT) * 4 + CAST('0x' || substr(md5(c_name), 25, 8) AS UBIGINT)) % 12 AS INTEGER)] AS voice FROM customer""")
def q_voice_pick(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", V.pool_voice(F.col("c_name")).alias("voice"))


@query("""SELECT conv_id, turn, md5('v=3|' || text || '|en-US-GuyNeural|edge-tts|1.0||native|style=default|exp=0.68|role=|ebias=') AS cache_key, md5(text || '|en-US-GuyNeural|edge-tts|1.0') AS text_hash FROM conversations""")
def q_cache_key(spark, sf):
    v, e, one = F.lit("en-US-GuyNeural"), F.lit("edge-tts"), F.lit(1.0)
    return _t(spark, sf, "conversations").select("conv_id", "turn", H.cache_key(F.col("text"), v, e, one, expressiveness=F.lit(0.68)).alias("cache_key"), H.text_hash(F.col("text"), v, e, one).alias("text_hash"))


@query("""WITH c AS (SELECT DISTINCT md5(text) AS k FROM conversations WHERE turn % 2 = 0)
SELECT role, count(*) AS total, count(k) AS hits FROM conversations LEFT JOIN c ON md5(text) = k GROUP BY role""")
def q_cache_probe(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("cache_key", F.md5("text"))
    cache = c.filter("turn % 2 = 0").select("cache_key", F.lit("f").alias("filename"), F.lit(1.0).alias("duration")).distinct()
    return C.probe(c, cache).groupBy("role").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "cached").alias("hits"))


@query("""SELECT conv_id, turn FROM conversations WHERE md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE turn % 2 = 0)""")
def q_pending_anti(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("cache_key", F.md5("text"))
    return C.pending(c, c.filter("turn % 2 = 0")).select("conv_id", "turn")


_ENTRY = """(SELECT event_id AS cache_key, ts AS last_accessed, CAST(1 + event_id % 97 AS BIGINT) AS size_bytes FROM events)"""


@query(f"""SELECT cache_key, size_bytes FROM (SELECT *, sum(size_bytes) OVER (ORDER BY last_accessed DESC, cache_key DESC) AS s FROM {_ENTRY}) WHERE s <= 100000""")
def q_lru(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_id").alias("cache_key"), F.col("ts").alias("last_accessed"), (1 + F.col("event_id") % 97).cast("long").alias("size_bytes"))
    return C.evict(e, 100_000).select("cache_key", "size_bytes")


@query("""SELECT event_id AS cache_key FROM events WHERE value > 20 AND event_id % 3 <> 0""")
def q_cache_repair(spark, sf):
    e = _t(spark, sf, "events")
    cache = e.select(F.col("event_id").alias("cache_key"), F.col("event_id").alias("filename"), F.col("value").alias("duration"), F.lit("").alias("sha256"))
    files = e.filter("value > 20").select(F.col("event_id").alias("filename"), (F.col("event_id") % 3).alias("size"), F.col("value").alias("measured"), F.lit("x").alias("sha"))
    return C.repair(cache, files)[0].select("cache_key")


@query()
def q_ssml(spark, sf):
    c = _t(spark, sf, "conversations")
    voices = V.catalogue(spark).select(F.col("id").alias("voice"), "styles", F.pmod(F.hash("id"), F.lit(7)).alias("v"))
    one = voices.groupBy("v").agg(F.min_by(F.struct("voice", "styles"), "voice").alias("x")).select("v", "x.voice", "x.styles")
    j = c.withColumn("v", F.pmod(F.col("conv_id"), F.lit(7)).cast("int")).join(F.broadcast(one), "v", "left")
    return S.with_markup(j, styles=F.col("styles")).select("conv_id", "turn", F.md5("ssml").alias("md5"))


@query("""SELECT id, label, locale FROM (VALUES ('en-US-AriaNeural', 'Aria (US, Female, Conversational)', 'en-US'), ('en-US-GuyNeural', 'Guy (US, Male, Narrator)', 'en-US'), ('en-GB-RyanNeural', 'Ryan (GB, Male, Natural)', 'en-GB')) t(id, label, locale)""")
def q_voices_whisper(spark, sf):
    """Voices of three that whisper; every one of them does."""
    v = V.catalogue(spark).filter(F.col("id").isin("en-US-AriaNeural", "en-US-GuyNeural", "en-GB-RyanNeural", "en-GB-SoniaNeural"))
    return v.filter(V.supports(F.col("styles"), F.lit("whispering"))).select("id", "label", "locale")


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS md5 FROM documents""")
def q_xml_escape(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.xml_escape(F.col("text"))).alias("md5"))


@query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(trim(p_name || ' (' || p_type || ')'), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'book') AS slug FROM part""")
def q_slug(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", X.slugify(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"))


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[\pL\pN\pM_]+|[^\pL\pN\pM_]+'), lambda x: CASE WHEN lower(x) IN ('the', 'thee') THEN '$d' ELSE x END), '')) AS md5 FROM documents""")
def q_pronounce(spark, sf):
    """Entries are applied one after another, so what the first writes is read by the second."""
    t = X.apply_pronunciation(F.col("text"), [("the", "thee"), ("thee", "$d")])
    return _t(spark, sf, "documents").select("doc_id", F.md5(t).alias("md5"))


@query()
def q_clean_desktop(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.clean_desktop(F.col("text"), "sql")).alias("md5"))


# ---- pages, projects, jobs, generic ---------------------------------------------------------


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\x0B]+', ' ', 'g'))) AS md5 FROM pages""")
def q_html_text(spark, sf):
    return pages_to_documents(_t(spark, sf, "pages")).select("page_id", F.md5("text").alias("md5"))


@query()
def q_html_blocks(spark, sf):
    return pages_to_documents(_t(spark, sf, "pages"), True).select("page_id", F.length("text").alias("n"), F.md5("text").alias("md5"))


@query(r"""SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, url LIKE 'http%' AS safe FROM pages""")
def q_url_host(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.url_host(F.col("url")).alias("host"), X.url_is_safe(F.col("url")).alias("safe"))


@query(f"""SELECT event_id, progress, CASE WHEN progress >= 100 THEN 'completed' WHEN progress < 10 THEN 'queued' ELSE 'processing' END AS status, CAST(ceil(greatest(0, target - elapsed) / 1000.0) AS BIGINT) AS eta_seconds
FROM (SELECT event_id, target, elapsed, CAST(least(100, greatest(0, floor(elapsed * 100 / greatest(1000, target)))) AS BIGINT) AS progress
FROM (SELECT event_id, greatest(4000, least(180000, CAST(floor(value * 1000 / 28 * 100) AS BIGINT))) AS target, (event_id * 37) % 200000 AS elapsed FROM events))""")
def q_job_projection(spark, sf):
    e = _t(spark, sf, "events")
    target = F.greatest(F.lit(4000), F.least(F.lit(180000), F.floor(F.col("value") * 1000 / 28 * 100)))
    s = P.job_status(F.lit(NOW_MS) - (F.col("event_id") * 37) % 200000, target, F.lit(NOW_MS))
    return e.select("event_id", s["progress"].alias("progress"), s["status"].alias("status"), s["eta_seconds"].alias("eta_seconds"))


@query("""SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000""")
def q_job_cap(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at_ms"))
    return P.keep_latest(e).select(F.col("job_id").alias("event_id"))


@query("""WITH m AS (SELECT 'm/' || doc_id || '.json' AS path, 'doc_' || doc_id AS title, doc_id FROM documents),
o AS (SELECT 'out/doc_' || doc_id || '.mp3' AS path, 'doc_' || doc_id AS stem FROM labels UNION ALL SELECT 'out/page_' || page_id || '.mp3', 'page_' || page_id FROM pages),
l AS (SELECT 'local::' || m.path AS id, title, 'local' AS storage, coalesce(o.path, '') AS output_path FROM m LEFT JOIN o ON m.title = o.stem)
SELECT * FROM l
UNION ALL SELECT 'cloud::u' || s, 'Cloud backup', 'cloud', '' FROM (SELECT DISTINCT doc_id % 5 AS s FROM m)
UNION ALL SELECT 'output::' || path, stem, 'output', path FROM o WHERE path NOT IN (SELECT output_path FROM l)""")
def q_inventory_union(spark, sf):
    """Projects of all documents, outputs of all labelled ones and of all pages."""
    d = _t(spark, sf, "documents")
    m = d.select(F.concat(F.lit("m/"), "doc_id", F.lit(".json")).alias("path"), F.concat_ws("_", F.lit("doc"), "doc_id").alias("title"), F.lit("parsed").alias("state"), F.concat(F.lit("u"), F.col("doc_id") % 5).alias("cloud_url"))
    stems = _t(spark, sf, "labels").select(F.concat_ws("_", F.lit("doc"), "doc_id").alias("stem")).unionByName(_t(spark, sf, "pages").select(F.concat_ws("_", F.lit("page"), "page_id").alias("stem")))
    o = stems.select(F.concat(F.lit("out/"), "stem", F.lit(".mp3")).alias("path"), F.concat("stem", F.lit(".mp3")).alias("name"), "stem", F.lit("mp3").alias("ext"))
    return P.inventory(spark, m, o).select("id", "title", "storage", "output_path")


@query("""SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.v, a.v) AS v FROM (SELECT doc_id, 'profile' AS v FROM documents) a FULL JOIN (SELECT doc_id, 'label' || toxic AS v FROM labels) b ON a.doc_id = b.doc_id""")
def q_map_merge(spark, sf):
    base = _t(spark, sf, "documents").select("doc_id", F.lit("profile").alias("v"))
    over = _t(spark, sf, "labels").select("doc_id", F.concat(F.lit("label"), "toxic").alias("v"))
    return V.merge_maps(base, over, "doc_id", "v")


@query("""SELECT event_id, json_valid(props) AS good FROM events""")
def q_json_props(spark, sf):
    from fablespark.sources.readers import tolerant_map

    return _t(spark, sf, "events").select("event_id", (F.size(tolerant_map(F.col("props"))) >= 0).alias("good"))


@query("""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_unlabelled(spark, sf):
    return _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 400 WHEN length(text) > 300 THEN 413 ELSE 0 END AS problem FROM conversations""")
def q_request_check(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(P.request_problem(F.col("text"), 300), F.lit(0)).alias("problem"))


@query("""SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN late > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_late FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS late FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY GROUP BY 1, 2) GROUP BY 1""")
def q_orders_late(spark, sf):
    """A generic join and aggregation; the semi-join keeps one pass over the large side."""
    o, l = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), _t(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    late = o.join(l, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 90 days")), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("with_late"))
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).join(late, "o_orderpriority", "left").select("o_orderpriority", "n", F.coalesce("with_late", F.lit(0)).alias("with_late"))


@query("""SELECT doc_id, coalesce(CASE WHEN length(trim(text)) > 0 THEN substr(md5(substr(trim(text), 1, 2000)), 1, 10) END, 'empty') AS signature FROM documents""")
def q_source_signature(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.lit(0).alias("chapter"), "text")
    return R.source_signature(d, ["doc_id"], "chapter")


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Network timeout' WHEN 'click' THEN 'Network' ELSE 'Processing' END AS category FROM events""")
def q_error_class(spark, sf):
    said = F.when(F.col("event_type") == "purchase", "it timed out").when(F.col("event_type") == "click", "DNS gave nothing").otherwise("odd")
    return _t(spark, sf, "events").select("event_id", X.error_class(said)["category"].alias("category"))


@query("""SELECT event_id, 'Generating audio · Chapter ' || user_id || ', segment ' || event_id || ' · Speaker ' || event_type AS message FROM events""")
def q_progress_message(spark, sf):
    raw = F.concat(F.lit("Generated chapter "), "user_id", F.lit(" ,  segment "), "event_id", F.lit(" ("), "event_type", F.lit(")"))
    return _t(spark, sf, "events").select("event_id", X.progress_message(raw).alias("message"))


@query("""SELECT p_partkey, CASE WHEN h > 0 THEN format('{:02d}:{:02d}:{:02d}', h, m, s) ELSE format('{:02d}:{:02d}', m, s) END AS eta
FROM (SELECT p_partkey, x // 3600 AS h, x % 3600 // 60 AS m, x % 60 AS s FROM (SELECT p_partkey, CAST(floor(p_retailprice * 5) AS BIGINT) AS x FROM part))""")
def q_eta_text(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", X.eta_text(F.floor(F.col("p_retailprice") * 5)).alias("eta"))


@query("""SELECT c_custkey, 'v' || c_nationkey AS name, '+' || (c_custkey % 9) || 'Hz' AS pitch, CAST(c_custkey % 9 AS DOUBLE) AS pitch_hz FROM customer""")
def q_voice_string(spark, sf):
    v = X.parse_voice(F.concat(F.lit("v"), "c_nationkey", F.lit("|pitch=+"), (F.col("c_custkey") % 9).cast("string"), F.lit("Hz|rate=-5%")))
    return _t(spark, sf, "customer").select("c_custkey", v.alias("v")).select("c_custkey", "v.name", "v.pitch", "v.pitch_hz")


@query("""SELECT user_id, count(*) AS words, min(event_type) AS first_word FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def q_overrides(spark, sf):
    e = _t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(" "), "event_type").alias("word"), F.col("event_id").cast("string").alias("sounds_like")))).alias("r"))
    m = e.select("user_id", X.overrides_map(F.col("r")).alias("m"))
    return m.select("user_id", F.size("m").cast("long").alias("words"), X.overrides_rows(F.col("m"))[0]["word"].alias("first_word"))


@query("""SELECT role, count(*) AS rows, CAST(0 AS BIGINT) AS express_as FROM conversations GROUP BY role""")
def q_markup_report(spark, sf):
    """Features of markup for voices without styles: nothing is wrapped."""
    c = _t(spark, sf, "conversations")
    return R.markup_report(S.with_markup(c), ["role"]).select("role", "rows", "express_as")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN NULL WHEN abs(f - 1) <= 0.0001 THEN 'anull' ELSE 'x' END AS kind FROM (SELECT o_orderkey, o_totalprice, CAST(1 + o_orderkey % 2 AS DOUBLE) AS f FROM orders)""")
def q_tempo(spark, sf):
    t = E.tempo_filter((1 + F.col("o_orderkey") % 2).cast("double"))
    return _t(spark, sf, "orders").select("o_orderkey", F.when(t == "anull", t).when(t == "atempo=2", "x").alias("kind"))


from fablespark.plans import derived as _derived  # noqa: E402, F401  its queries and SQL register themselves here
