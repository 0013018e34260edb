"""Aggregates, timelines and previews over segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fablespark.functions.hashing import content_signature
from fablespark.functions.text import truncate
from fablespark.operators.ssml import feature_counts
from fablespark.operators.voices import is_narrator


def chapter_table(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Per chapter: segments, distinct characters without the narrator, cached, "cached/total"."""
    out = segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), F.count_distinct(F.when(~is_narrator(F.col("speaker")), F.col("speaker"))).alias("characters"), F.count_if(F.col("status") == "cached").alias("cached"))
    return out.withColumn("done", F.concat_ws("/", F.col("cached").cast("string"), F.col("segments").cast("string")))


def chapter_progress(chapters: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """Per chapter, also those without segments: done, total, status; an empty chapter is complete."""
    s = segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "cached").alias("done"), F.bool_and(F.col("status") == "cached").alias("all"))
    j = chapters.join(s, keys, "left")
    done, total = F.coalesce("done", F.lit(0)), F.coalesce("total", F.lit(0))
    return j.select(*keys, done.alias("done"), total.alias("total"), F.when(total == 0, 0).otherwise(F.bround(100 * done / total)).cast("long").alias("percent"), F.when(F.coalesce("all", F.lit(True)), "complete").otherwise("pending").alias("status"))


def character_table(voices: DataFrame, segs: DataFrame) -> DataFrame:
    """Characters by name with voice, who detected them and their segments."""
    n = segs.filter(~is_narrator(F.col("speaker"))).groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))
    return voices.join(n, "speaker", "left").select("speaker", "voice", "detected_by", F.coalesce("n", F.lit(0)).alias("segments")).orderBy("speaker")


def has_errors(segs: DataFrame, files: DataFrame) -> DataFrame:
    """One row: whether a segment failed, or is cached and its file is missing."""
    f = files.select(F.col("path").alias("__path")).distinct()
    return segs.join(f, F.col("cache_file") == F.col("__path"), "left").agg(F.coalesce(F.bool_or((F.col("status") == "error") | ((F.col("status") == "cached") & F.col("__path").isNull())), F.lit(False)).alias("has_errors"))


def timeline(segs: DataFrame, book: list[str], chapter: str) -> DataFrame:
    """Start and end of each chapter in ms: clip lengths and the silences the assembly puts in."""
    gap = F.when(F.col("scene_break_after"), 1000).when(F.col("paragraph_break_after"), 500).otherwise(0) + F.when(~F.coalesce(F.col("speaker"), F.lit("narrator")).isin("narrator"), 300).otherwise(0)
    own = segs.groupBy(*book, chapter).agg(F.sum((F.coalesce("duration_seconds", F.lit(0.0)) * 1000).cast("long") + gap).alias("ms"))
    order = Window.partitionBy(*book).orderBy(chapter)
    own = own.withColumn("ms", F.col("ms") + F.when(F.lead(chapter).over(order).isNotNull(), 2000).otherwise(0))
    end = F.sum("ms").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return own.select(*book, chapter, (end - F.col("ms")).alias("start_ms"), end.alias("end_ms"))


def metadata_text(times: DataFrame, titles: DataFrame, book: list[str], chapter: str) -> DataFrame:
    """Chapter metadata of each book as one text. titles: book keys, chapter, title, book_title, author."""
    joined = times.join(titles, [*book, chapter])
    block = F.concat_ws("\n", F.lit("[CHAPTER]\nTIMEBASE=1/1000"), F.concat(F.lit("START="), F.col("start_ms")), F.concat(F.lit("END="), F.col("end_ms")), F.concat(F.lit("title="), F.col("title")), F.lit(""))
    rows = joined.groupBy(*book).agg(F.first("book_title").alias("t"), F.first("author").alias("a"), F.array_sort(F.collect_list(F.struct(chapter, block.alias("b")))).alias("all"))
    title, author = F.coalesce("t", F.lit("Untitled")), F.coalesce("a", F.lit("Unknown"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), title, F.lit("\nartist="), author, F.lit("\nalbum="), title, F.lit("\ngenre=Audiobook\n\n"))
    return rows.select(*book, F.concat(head, F.array_join(F.transform("all", lambda x: x["b"]), "\n")).alias("text"))


def playlist(segs: DataFrame, book: list[str], chapter: str) -> DataFrame:
    """Files to concatenate, in order: clip, dialogue gap, scene or paragraph gap, chapter gap."""
    item = lambda when, k, name: F.struct(F.lit(k).alias("k"), F.when(when, name).alias("file"))
    order = Window.partitionBy(*book).orderBy(chapter, "seg_idx")
    last_in_chapter = F.lead(chapter).over(order).isNotNull() & (F.lead(chapter).over(order) != F.col(chapter))
    rows = segs.withColumn("__last", last_in_chapter)
    files = F.array(
        F.struct(F.lit(0).alias("k"), F.col("cache_file").alias("file")),
        item(~F.coalesce(F.col("speaker"), F.lit("narrator")).isin("narrator"), 1, "silence_03s"),
        item(F.col("scene_break_after"), 2, "silence_1s"),
        item(~F.col("scene_break_after") & F.col("paragraph_break_after"), 3, "silence_05s"),
        item(F.col("__last"), 4, "silence_2s"),
    )
    return rows.select(*book, chapter, "seg_idx", F.explode(F.filter(files, lambda f: f["file"].isNotNull())).alias("f")).select(*book, chapter, "seg_idx", "f.k", "f.file")


def hit_rate(hits: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(F.round(hits / F.greatest(total, F.lit(1)), 4))


def stage_timings(metrics: DataFrame) -> DataFrame:
    """Latest seconds of each stage of a project, in columns parse, generate, assemble."""
    latest = metrics.filter(F.col("name") == "seconds").groupBy("project_id", "stage").agg(F.max_by("value", "ts").alias("seconds"))
    return latest.groupBy("project_id").pivot("stage", ["parse", "generate", "assemble"]).agg(F.first("seconds"))


def preview(chapters: DataFrame, segs: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """The first chapters with their number of segments, a snippet, and how many more there are."""
    s = segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "seg_idx").alias("first"))
    total = chapters.agg(F.count(F.lit(1)).alias("__total"))
    rows = chapters.join(s, keys, "left").crossJoin(F.broadcast(total)).orderBy(*keys).limit(most)
    snippet = truncate(F.replace(F.trim(F.coalesce("first", F.lit(""))), F.lit("\n"), F.lit(" ")), 160)
    return rows.select(*keys, "title", F.coalesce("n", F.lit(0)).alias("segments"), snippet.alias("snippet"), F.greatest(F.col("__total") - most, F.lit(0)).alias("more"))


def dialogue_review(segs: DataFrame, order: list[str], most: int = 16) -> DataFrame:
    """The first attributed segments with a short sample."""
    return segs.filter(~is_narrator(F.lower("speaker"))).orderBy(*order).limit(most).select(*order, "speaker", "speaker_method", "speaker_confidence", truncate(F.replace(F.trim("text"), F.lit("\n"), F.lit(" ")), 100).alias("sample"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str], most: int = 10_000) -> DataFrame:
    """One row: the table as markdown, for reports that a person reads; over ``most`` rows are an error."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    body = rows.limit(most + 1).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("all"))
    head = "| " + " | ".join(columns) + " |\n|" + "|".join(["---"] * len(columns)) + "|\n"
    table = F.when(F.size("all") == 0, "_No data yet._").otherwise(F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["line"]), "\n")))
    return body.select(F.when(F.size("all") > most, F.raise_error(F.lit(f"more than {most} rows for one report")).cast("string")).otherwise(table).alias("markdown"))


def run_state(events: DataFrame) -> DataFrame:
    """The current state of each project from appended (project_id, state, message, updated_at)."""
    return events.groupBy("project_id").agg(F.max_by(F.struct("state", "message"), "updated_at").alias("s"), F.max("updated_at").alias("updated_at")).select("project_id", "s.state", "s.message", "updated_at")


def source_signature(chapters: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Ten hex digits for the first chapter with content of each source."""
    full = chapters.filter(F.length(F.trim("text")) > 0).groupBy(*keys).agg(F.min_by(F.substring(F.trim("text"), 1, 2000), index).alias("t"))
    return chapters.select(*keys).distinct().join(full, keys, "left").select(*keys, content_signature(F.coalesce("t", F.lit(""))).alias("signature"))


def markup_report(marked: DataFrame, by: list[str], markup: str = "ssml") -> DataFrame:
    """Sums of markup features by group."""
    counted = marked.withColumn("__n", feature_counts(F.col(markup)))
    return counted.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(f"__n.{c}").alias(c) for c in ("express_as", "breaks", "emphasis", "prosody")))
