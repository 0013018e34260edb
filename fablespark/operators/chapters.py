"""Chapters, scenes, paragraphs and size-bounded segments.

Everything here is a column expression on one document's text, so it needs no shuffle; rows are
made by exploding the arrays. Where a rule needs match positions, find_spans() gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fablespark.functions.text import cut_apart, find_all_spans, find_spans, guarded_sentences, let, normalize_text, sentences, strip

# Chapter headings of the desktop dialect (Python patterns, multi-line).
CHAPTER_PATTERNS = [
    r"(?m)^(?:CHAPTER|Chapter)\s+(?:\d+|[IVXLCDM]+|[A-Z][a-z]+(?:\s[A-Z][a-z]+)?)(?:\s*[:.\-—]\s*.+)?$",
    r"(?m)^(?:PART|Part)\s+(?:\d+|[IVXLCDM]+|[A-Z][a-z]+)",
    r"(?m)^\s*\d{1,3}\.?\s*$",
    r"(?m)^([A-Z][A-Z\s]{2,58})$(?=\s*\n\s*\n)",
    r"(?m)^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,8})\s*$(?=\s*\n\s*\n)",
]
# Scene breaks (Python patterns, multi-line).
SCENE_PATTERNS = [r"(?m)^\s*\*\s*\*\s*\*\s*$", r"(?m)^\s*\*{3,}\s*$", r"(?m)^\s*-{3,}\s*$", r"(?m)^\s*~{3,}\s*$", r"(?m)^\s*#\s*$", r"\n{3,}"]
SEPARATOR = r"^(?:\*{3,}|-{4,}|~{3,}|#)$"
MIN_GAP = 200


def split_chapters(docs: DataFrame, text: str = "text", keep_prologue: bool = False) -> DataFrame:
    """Desktop dialect: docs with chapter_idx, title, text for each chapter; others columns kept.

    Under two markers the whole text is "Chapter 1". Text before the first marker is left out
    unless ``keep_prologue``.
    """
    marked = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__kept", cut_apart(F.col("__text"), CHAPTER_PATTERNS, MIN_GAP))
    whole = F.array(F.struct(F.lit("Chapter 1").alias("title"), strip(F.col("__text")).alias("text")))
    kept, n = F.col("__kept"), F.size("__kept")
    parts = F.transform(kept, lambda m: F.struct(strip(m["title"]).alias("title"), strip(m["text"]).alias("text")))
    if keep_prologue:
        before = F.struct(F.lit("Prologue").alias("title"), strip(F.substr(F.col("__text"), F.lit(1), kept[0]["position"])).alias("text"))
        parts = F.concat(F.array(before), parts)
    parts = F.filter(parts, lambda c: F.length(c["text"]) > 0)
    chosen = F.when((n < 2) | (F.size(parts) == 0), whole).otherwise(parts)
    rest = [c for c in docs.columns if c != text]
    return marked.select(*rest, F.posexplode(chosen).alias("chapter_idx", "__c")).select(*rest, "chapter_idx", "__c.title", "__c.text")


_OPEN, _SHUT = "\x01", "\x02"
_WEB_LINE = r"(?im)^([^\S\n]*(?=[^\n]{1,120}$)(?:chapter|part|book|section)[^\S\n]+[ivxlcdm0-9]+[:.\s&&[^\n]-]*[^\n]*)$"


def split_chapters_web(docs: DataFrame, text: str = "text") -> DataFrame:
    """Web dialect: heading lines start chapters, text before the first is "Prologue".

    Headings are put between two control characters, so that two splits give the chapters.
    """
    plain = F.translate(normalize_text(F.col(text)), _OPEN + _SHUT, "")
    pieces = F.split(F.regexp_replace(plain, _WEB_LINE, f"{_OPEN}$1{_SHUT}"), _OPEN)
    halves = F.transform(pieces, lambda p: F.split(p, _SHUT))
    made = F.transform(halves, lambda h, i: F.struct(F.when(i == 0, "Prologue").otherwise(strip(h[0])).alias("title"), F.when(i == 0, h[0]).otherwise(h[1]).alias("body"), i.alias("i")))
    # a heading's body starts with its line end; a chapter without lines is none
    made = F.filter(made, lambda c: F.when(c["i"] == 0, F.length(c["body"]) > 0).otherwise(F.length(c["body"]) > 1))
    rest = [c for c in docs.columns if c != text]
    named = docs.withColumn("__made", made)
    alone = (F.size("__made") == 1) & (F.get(F.col("__made"), F.lit(0))["i"] == 0)
    chapters = F.transform("__made", lambda c: F.struct(F.when(alone, "Chapter 1").otherwise(c["title"]).alias("title"), strip(c["body"]).alias("text")))
    return named.select(*rest, F.posexplode(F.filter(chapters, lambda c: F.length(c["text"]) > 0)).alias("chapter_idx", "__c")).select(*rest, "chapter_idx", "__c.title", "__c.text")


def scene_breaks(text: Column) -> Column:
    """Sorted distinct start offsets of scene breaks."""
    return F.array_sort(F.array_distinct(F.transform(find_all_spans(text, SCENE_PATTERNS), lambda s: s["start"])))


PARAGRAPH_GAP = r"\n\s*\n"


def paragraphs(text: Column, gaps: Column) -> Column:
    """(start, text) of paragraphs between empty lines, trimmed; start is before trimming.

    ``gaps`` is a column of find_spans(text, PARAGRAPH_GAP).
    """
    cuts = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.transform(gaps, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    following = lambda i: F.when(i + 1 < F.size(cuts), F.get(cuts, i + 1)["start"]).otherwise(F.length(text))
    found = F.transform(cuts, lambda c, i: F.struct(c["end"].alias("start"), strip(F.substr(text, c["end"] + 1, following(i) - c["end"])).alias("text")))
    return F.filter(found, lambda p: F.length(p["text"]) > 0)


def pack_sentences(text: Column, most: int = 5500) -> Column:
    """Desktop dialect: sentences joined by spaces up to ``most`` characters; a longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("size"))

    def step(a: Column, s: Column) -> Column:
        size = F.length(s) + 1
        full = (F.size(a["now"]) > 0) & (a["size"] + size > most)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(strip(F.array_join(a["now"], " "))))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(s)).otherwise(F.concat(a["now"], F.array(s))).alias("now"),
            F.when(full, size).otherwise(a["size"] + size).alias("size"),
        )

    packed = F.aggregate(sentences(text), start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(strip(F.array_join(a["now"], " "))))).otherwise(a["done"]))
    return F.when(F.length(text) <= most, F.array(strip(text))).otherwise(packed)


def _hard_split(sentence: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, cut at the last space of a piece's second half."""
    half = limit // 2
    start = F.struct(F.array().cast("array<string>").alias("out"), sentence.alias("rest"))

    def step(a: Column, _: Column) -> Column:
        head = F.substring(a["rest"], 1, limit + 1)
        at = F.length(head) - F.instr(F.reverse(head), " ")
        cut = F.when((F.instr(head, " ") == 0) | (at < half), limit).otherwise(at)
        more = F.struct(F.concat(a["out"], F.array(strip(F.substr(a["rest"], F.lit(1), cut)))).alias("out"), strip(F.substr(a["rest"], cut + 1)).alias("rest"))
        return F.when(F.length(a["rest"]) > limit, more).otherwise(a)

    turns = F.sequence(F.lit(1), F.ceil(F.length(sentence) / half).cast("int") + 1)
    return F.aggregate(turns, start, step, lambda a: F.concat(a["out"], F.array(a["rest"])))


def chunk_web(text: Column, most: int = 2200) -> Column:
    """Web dialect: chunks of at most ``most`` (400 to 7800) characters at sentence and paragraph ends."""
    limit = min(7800, max(400, most))
    body = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))
    paras = F.filter(F.transform(F.split(body, r"\n{2,}"), strip), lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def flush(a: Column, when: Column) -> Column:
        trimmed = strip(a["buf"])
        out = F.when(F.length(trimmed) > 0, F.concat(a["out"], F.array(trimmed))).otherwise(a["out"])
        return F.struct(F.when(when, out).otherwise(a["out"]).alias("out"), F.when(when, F.lit("")).otherwise(a["buf"]).alias("buf"))

    def add(a: Column, s: Column) -> Column:
        empty = F.length(a["buf"]) == 0
        size = F.length(s) + F.when(empty, 0).otherwise(F.length(a["buf"]) + 1)
        flushed = F.when(empty, a["out"]).otherwise(F.concat(a["out"], F.array(strip(a["buf"]))))
        split = let(_hard_split(s, limit), lambda p: F.struct(F.concat(flushed, F.slice(p, 1, F.size(p) - 1)).alias("out"), F.element_at(p, -1).alias("buf")))
        fresh = F.struct(flushed.alias("out"), s.alias("buf"))
        grown = F.struct(a["out"].alias("out"), F.when(empty, s).otherwise(F.concat(a["buf"], F.lit(" "), s)).alias("buf"))
        return F.when(size <= limit, grown).when(F.length(s) <= limit, fresh).otherwise(split)

    def paragraph(a: Column, p: Column) -> Column:
        start = flush(a, (F.length(a["buf"]) > 0) & (F.length(a["buf"]) + F.length(p) + 1 > limit))
        return let(F.aggregate(guarded_sentences(p), start, add), lambda b: flush(b, F.length(b["buf"]) > int(limit * 0.65)))

    return F.aggregate(paras, start, paragraph, lambda a: F.when(F.length(strip(a["buf"])) > 0, F.concat(a["out"], F.array(strip(a["buf"])))).otherwise(a["out"]))


def segments(chapters: DataFrame, keys: list[str], most: int = 5500) -> DataFrame:
    """Desktop dialect segments of chapters: offsets, text, epoch and break flags.

    A separator paragraph makes no segment; it ends an epoch and marks the segment before it.
    ``keys`` name one chapter each; chapters that share them would be numbered as one.
    Columns: keys, seg_idx, start, end, text, epoch, paragraph_break_after, scene_break_after.
    """
    text = F.col("text")
    rows = chapters.select(*keys, text, scene_breaks(text).alias("__breaks"), find_spans(text, PARAGRAPH_GAP).alias("__gaps"))
    rows = rows.withColumn("__paras", F.transform(paragraphs(text, F.col("__gaps")), lambda p: F.struct(p["start"].alias("start"), p["text"].alias("text"), p["text"].rlike(SEPARATOR).alias("cut"))))
    rows = rows.withColumn("__cuts", F.filter(F.transform("__paras", lambda p, i: F.when(p["cut"], i)), lambda i: i.isNotNull()))

    def place(p: Column, i: Column) -> Column:
        """A paragraph with all that its segments need, so that nothing of the chapter goes along with it."""
        near = F.filter("__breaks", lambda b: (b > p["start"] - 4) & (b < p["start"] + F.length(p["text"]) + 4))
        epoch = F.size(F.filter("__cuts", lambda c: c < i))
        return F.struct(p["start"].alias("start"), p["text"].alias("text"), epoch.alias("epoch"), p["cut"].alias("cut"), F.array_contains("__cuts", i + 1).alias("next_cut"), near.alias("breaks"))

    paras = rows.select(*keys, F.posexplode(F.transform("__paras", place)).alias("__p", "para")).filter(~F.col("para.cut"))
    chunks = pack_sentences(F.col("para.text"), most)
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<rel:int,text:string>>").alias("out"))

    def find(a: Column, c: Column) -> Column:
        at = F.call_function("locate", c, F.col("para.text"), a["cursor"] + 1) - 1
        rel = F.when(at < 0, a["cursor"]).otherwise(at)
        return F.struct((rel + F.length(c)).alias("cursor"), F.concat(a["out"], F.array(F.struct(rel.alias("rel"), c.alias("text")))).alias("out"))

    found = paras.withColumn("__chunks", F.aggregate(chunks, start, find, lambda a: a["out"]))
    out = found.select(*keys, "__p", "para", F.size("__chunks").alias("__n"), F.posexplode("__chunks").alias("__i", "c"))
    begin = F.col("para.start") + F.col("c.rel")
    end = begin + F.length("c.text")
    last = F.col("__i") == F.col("__n") - 1
    near = F.exists("para.breaks", lambda p: F.abs(p - end) < 4)
    order = Window.partitionBy(*keys).orderBy("__p", "__i")
    return out.select(*keys, (F.row_number().over(order) - 1).alias("seg_idx"), begin.alias("start"), end.alias("end"), F.col("c.text").alias("text"), F.col("para.epoch").alias("epoch"), last.alias("paragraph_break_after"), (near | (last & F.col("para.next_cut"))).alias("scene_break_after"))
