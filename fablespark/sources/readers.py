"""Readers that give one document table: path, title, text or chapters; and the manifest reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fablespark.functions.text import file_kind, html_blocks_to_text, html_dom_text, html_to_text, url_host
from fablespark.sources.pdf import read_pdf

CHAPTERS = "path string, chapter_idx int, title string, text string"
MOST_BYTES = 500 * 1024 * 1024

MANIFEST = """
version string,
book struct<title:string,author:string,source_file:string,source_type:string>,
settings struct<tts_engine:string,narrator_voice:string,dialogue_voice:string,
  character_voices:map<string,struct<voice:string,detected_by:string>>,pronunciation_overrides:map<string,string>,
  speed_multiplier:double,speed_mode:string,dialogue_detection_strategy:string>,
chapters array<struct<index:int,title:string,status:string,segments:array<struct<index:int,text:string,text_hash:string,
  speaker:string,speaker_method:string,speaker_confidence:double,voice:string,cache_file:string,duration_seconds:double,
  status:string,paragraph_break_after:boolean,scene_break_after:boolean>>>>,
progress struct<total_segments:int,completed_segments:int,generation_started:string,estimated_remaining_seconds:int>,
runtime struct<state:string,message:string,updated_at:string,project_id:string,cloud_backup:struct<enabled:boolean,url:string>>,
character_occurrences map<string,int>
"""


def _stem(path):
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, title (file stem), text."""
    name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, wholetext=True).select(name.alias("path"), F.col("value").alias("text")).select("path", _stem(F.col("path")).alias("title"), "text")


def inline_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("inline", "Pasted Text", text)], "path string, title string, text string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes with length and time; over ``MOST_BYTES`` they raise an error when read."""
    files = spark.read.format("binaryFile").load(path)
    too_large = F.raise_error(F.concat(F.lit("file is too large: "), F.col("path"))).cast("binary")
    return files.withColumn("content", F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(too_large))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, stem, ext, length, modificationTime without reading contents."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", name.alias("name"), _stem(F.col("path")).alias("stem"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("ext"), "length", "modificationTime")


def stale_files(files: DataFrame, now) -> DataFrame:
    """Files last changed over an hour before ``now``."""
    return files.filter(F.col("modificationTime") < now - F.expr("interval 1 hour"))


def _by_file(files: DataFrame, parse) -> DataFrame:
    """Rows (chapter_idx, title, text) that ``parse`` makes of each file's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(parse(path, bytes(content)))
                yield pd.DataFrame({"path": [path] * len(rows), "chapter_idx": range(len(rows)), "title": [r[0] for r in rows], "text": [r[1] for r in rows]})

    return files.select("path", "content").mapInPandas(run, CHAPTERS)


_TAG = re.compile(r"(?s)<[^>]+>")


def _plain(markup: str) -> str:
    import html

    body = re.sub(r"(?is)<head\b.*?</head>|<(script|style)\b.*?</\1\s*>", "", markup)
    body = re.sub(r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|blockquote|tr)\s*>", "\n", body)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", html.unescape(_TAG.sub("", body)))).strip()


def _epub_items(content: bytes) -> list[tuple[str, str]]:
    """(name, markup) of an EPUB's documents in spine order; all pages by name where there is no spine."""
    import posixpath
    from xml.etree import ElementTree

    book = zipfile.ZipFile(io.BytesIO(content))
    names = {n.lower(): n for n in book.namelist()}
    read = lambda n: book.read(names[n.lower()]).decode("utf-8", "ignore")
    order: list[str] = []
    try:
        root = ElementTree.fromstring(book.read(names["meta-inf/container.xml"]))
        opf = next(e.attrib["full-path"] for e in root.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(names[opf.lower()]))
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item")}
        refs = [e.attrib["idref"] for e in package.iter() if e.tag.endswith("}itemref")]
        order = [posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[r])) for r in refs if r in items]
        order = [n for n in order if n.lower() in names]
    except (KeyError, StopIteration, ElementTree.ParseError):
        order = []
    if not order:
        order = sorted(n for n in book.namelist() if n.lower().endswith((".html", ".xhtml", ".htm")))
    return [(n, read(n)) for n in order]


def _title_of(name: str) -> str:
    return re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1])


def _epub_chapters(name: str, content: bytes, least: int = 80, whole: bool = False) -> Iterator[tuple[str, str]]:
    texts = []
    for _, markup in _epub_items(content):
        head = re.search(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>", markup)
        texts.append((_plain(head[1]) if head else "", _plain(markup)))
    if whole:
        yield _title_of(name), "\n\n".join(t for _, t in texts if t)
        return
    kept = [(title, text) for title, text in texts if len(text) >= least]
    for i, (title, text) in enumerate(kept):
        yield title or f"Chapter {i + 1}", text
    if not kept:
        yield "Chapter 1", ""


def _docx_text(name: str, content: bytes) -> Iterator[tuple[str, str]]:
    from xml.etree import ElementTree

    book = zipfile.ZipFile(io.BytesIO(content))
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(book.read("word/document.xml"))
    paras = ["".join(t.text or "" for t in p.iter(f"{word}t")) for p in root.iter(f"{word}p")]
    title = ""
    if "docProps/core.xml" in book.namelist():
        title = next((e.text or "" for e in ElementTree.fromstring(book.read("docProps/core.xml")).iter() if e.tag.endswith("}title")), "")
    yield title or _title_of(name), "\n\n".join(p for p in paras if p.strip())


def read_epub(spark: SparkSession, path: str, least: int = 80, whole: bool = False) -> DataFrame:
    """Chapters of EPUB files: one for each item of at least ``least`` characters, titled by its heading.

    ``whole`` gives one text with all items instead.
    """
    return _by_file(read_files(spark, path), lambda name, content: _epub_chapters(name, content, least, whole))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of DOCX files as one text, titled by the document's properties or its name."""
    return _by_file(read_files(spark, path), _docx_text)


def read_sources(spark: SparkSession, path: str | None = None, pages: DataFrame | None = None, raw_text: str | None = None) -> DataFrame:
    """Chapters of whatever is given: pasted text, else fetched pages (url, html), else files of any kind under a path.

    Files are read by their extension, unknown ones as text. Formats that are refused raise an error that names the file.
    Columns: path, source_type, chapter_idx, title, text.
    """
    if raw_text:
        return inline_text(spark, raw_text).select("path", F.lit("text").alias("source_type"), F.lit(0).alias("chapter_idx"), "title", "text")
    if pages is not None:
        return pages.select(F.col("url").alias("path"), F.lit("url").alias("source_type"), F.lit(0).alias("chapter_idx"), url_host(F.col("url")).alias("title"), html_blocks_to_text(F.col("html")).alias("text"))
    if not path:
        raise ValueError("give a text, pages or a path")
    files = read_files(spark, path).withColumn("kind", F.coalesce(file_kind(F.regexp_extract("path", r"([^/]*)$", 1)), F.lit("refused")))
    bad = F.raise_error(F.concat(F.lit("no reader for this format: "), F.col("path"))).cast("binary")
    files = files.withColumn("content", F.when(F.col("kind") == "refused", bad).otherwise(F.col("content")))

    def parse(name: str, content: bytes) -> Iterator[tuple[str, str]]:
        kind = name.rsplit(".", 1)[-1].lower()
        if kind in ("epub", "docx"):
            return _epub_chapters(name, content) if kind == "epub" else _docx_text(name, content)
        return iter([(_title_of(name), content.decode("utf-8", "replace"))])

    kind = F.coalesce(file_kind(F.regexp_extract("path", r"([^/]*)$", 1)), F.lit("refused"))
    chapters = _by_file(files.filter("kind <> 'pdf'"), parse).unionByName(read_pdf(files.filter("kind = 'pdf'").select("path", "content")))
    return chapters.select("path", kind.alias("source_type"), "chapter_idx", "title", "text")


def pdf_lines(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of PDF pages from characters (keys, page, top, x0, size, text): line, text, size."""
    rows = chars.groupBy(*keys, "page", F.bround(F.col("top") / 2).cast("long").alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"]), "").alias("text"), F.avg("size").alias("size"))


def is_mark(text: str):
    """Whether a line of this text and its ``size`` starts a chapter."""
    return (F.col("size") > 14) & (F.length(F.trim(text)) < 80) & (F.length(F.trim(text)) > 0)


def pdf_chapters(pages: DataFrame, lines: DataFrame, keys: list[str], title_of_next: bool = False) -> DataFrame:
    """Chapters of pages (keys, page, text): a page with a large short line starts one.

    The title is the first such line of the chapter's own first page; ``title_of_next`` takes it from
    the page that starts the next chapter instead.
    """
    marks = lines.filter(is_mark("text")).groupBy(*keys, "page").agg(F.min_by("text", "line").alias("title"))
    return marked_chapters(pages.join(marks, [*keys, "page"], "left"), keys, title_of_next)


def marked_chapters(pages: DataFrame, keys: list[str], title_of_next: bool = False) -> DataFrame:
    """Chapters of pages (keys, page, text, title), as pdf_chapters() gives them; a page with a title starts one."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("page")
    joined = pages.withColumn("chapter_idx", F.sum(F.col("title").isNotNull().cast("int")).over(order))
    made = joined.groupBy(*keys, "chapter_idx").agg(F.min_by("title", "page").alias("own"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))
    by = Window.partitionBy(*keys).orderBy("chapter_idx")
    title = F.lead("own").over(by) if title_of_next else F.col("own")
    return made.withColumn("title", F.coalesce(title, F.concat(F.lit("Chapter "), F.row_number().over(by)))).drop("own").filter(F.length(F.trim("text")) > 0)


def pages_to_documents(pages: DataFrame, blocks: bool | str = False) -> DataFrame:
    """Fetched pages (page_id, url, html) with their text.

    ``blocks`` keeps line ends of blocks: True by patterns, "dom" by nesting, where removed blocks nest.
    """
    how = html_dom_text if blocks == "dom" else html_blocks_to_text if blocks else html_to_text
    return pages.withColumn("text", how(F.col("html")))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with declared types; where one is damaged or lacks chapters, its .bak takes its place."""

    def read(pattern: str) -> DataFrame:
        files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
        parsed = F.from_json("value", MANIFEST + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
        return files.select("path", parsed.alias("m")).select("path", "m.*")

    whole = read("*.json").filter(F.col("_corrupt_record").isNull())
    spare = read("*.bak").filter(F.col("_corrupt_record").isNull()).withColumn("path", F.regexp_replace("path", r"\.bak$", ""))
    return with_defaults(whole.unionByName(spare.join(whole.select("path"), "path", "left_anti")).drop("_corrupt_record"))


def with_defaults(manifests: DataFrame) -> DataFrame:
    """Fields that are missing get their defaults."""
    s, r = F.col("settings"), F.col("runtime")
    settings = F.struct(
        F.coalesce(s["tts_engine"], F.lit("edge-tts")).alias("tts_engine"),
        F.coalesce(s["narrator_voice"], F.lit("en-GB-ThomasMultilingualNeural|pitch=-3Hz")).alias("narrator_voice"),
        F.coalesce(s["dialogue_voice"], F.lit("en-US-AvaMultilingualNeural|pitch=+2Hz")).alias("dialogue_voice"),
        F.coalesce(s["character_voices"], F.create_map().cast("map<string,struct<voice:string,detected_by:string>>")).alias("character_voices"),
        F.coalesce(s["pronunciation_overrides"], F.create_map().cast("map<string,string>")).alias("pronunciation_overrides"),
        F.coalesce(s["speed_multiplier"], F.lit(1.0)).alias("speed_multiplier"),
        F.coalesce(s["speed_mode"], F.lit("native")).alias("speed_mode"),
        F.coalesce(s["dialogue_detection_strategy"], F.lit("auto")).alias("dialogue_detection_strategy"),
    )
    runtime = F.struct(F.coalesce(r["state"], F.lit("idle")).alias("state"), F.coalesce(r["message"], F.lit("")).alias("message"), r["updated_at"].alias("updated_at"), r["project_id"].alias("project_id"), r["cloud_backup"].alias("cloud_backup"))
    return manifests.withColumn("settings", settings).withColumn("runtime", runtime)


def manifest_segments(manifests: DataFrame) -> DataFrame:
    """One row for each segment of each manifest."""
    c = manifests.select("path", F.posexplode("chapters").alias("chapter_idx", "c"))
    return c.select("path", "chapter_idx", F.col("c.title").alias("title"), F.posexplode("c.segments").alias("seg_idx", "s")).select("path", "chapter_idx", "title", "seg_idx", *(F.col(f"s.{n}").alias(n) for n in ("text", "speaker", "voice", "cache_file", "duration_seconds", "paragraph_break_after", "scene_break_after")), F.coalesce("s.status", F.lit("pending")).alias("status"))


def tolerant_map(json_text):
    """A JSON object as a string map; empty for anything else."""
    return F.coalesce(F.from_json(json_text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def open_map(json_text: Column) -> Column:
    """A JSON object as a map of variants, keys and values of any kind kept; empty for anything else."""
    whole = F.try_variant_get(F.try_parse_json(json_text), "$", "map<string,variant>")
    return F.coalesce(whole, F.create_map().cast("map<string,variant>"))


def _variant(value: Column) -> Column:
    """Any value as a variant; null as the JSON null."""
    return F.variant_get(F.to_variant_object(F.struct(value.alias("v"))), "$.v", "variant")


def put_keys(json_text: Column, new: dict[str, Column]) -> Column:
    """The JSON object with the keys of ``new`` put in or replaced; all other keys stay, whatever they hold.

    Anything but an object counts as an empty one; a null value becomes the JSON null.
    """
    added = F.create_map(*(x for k, v in new.items() for x in (F.lit(k), _variant(v))))
    kept = F.map_filter(open_map(json_text), lambda k, _: ~k.isin(*new))
    return F.to_json(F.map_concat(kept, added), {"ignoreNullFields": "false"})


def merge_known(known: Column, kind: T.DataType, raw: Column) -> Column:
    """``known``, a struct read by a schema, laid over ``raw``, the variant that it was read from, as a map of variants.

    Keys that the schema does not name stay in nested structs too; elements of arrays are matched by their
    ``index``; inside maps and other arrays what the schema does not name is lost. A field that is null in ``known`` leaves what ``raw`` has.
    """
    entries = []
    for f in kind.fields:
        old = F.try_variant_get(raw, f"$.{f.name}", "variant")
        entries += [F.lit(f.name), _merged(known[f.name], f.dataType, old)]
    own = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    rest = F.coalesce(F.try_variant_get(raw, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.map_concat(F.map_filter(rest, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def _merged(value: Column, kind: T.DataType, old: Column) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.to_variant_object(merge_known(value, kind, old)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "index" in kind.elementType.names:
        before = F.coalesce(F.try_variant_get(old, "$", "array<variant>"), F.array().cast("array<variant>"))
        same = lambda x: F.get(F.filter(before, lambda v: F.try_variant_get(v, "$.index", "long") == x["index"]), F.lit(0))
        return F.when(value.isNotNull(), F.to_variant_object(F.transform(value, lambda x: merge_known(x, kind.elementType, same(x)))))
    return F.when(value.isNotNull(), _variant(value))


def manifest_text(manifests: DataFrame, raw: Column) -> Column:
    """Manifests as JSON text, with all that ``raw``, the text that each was read from, has beside the declared fields."""
    kind = T.StructType.fromDDL(MANIFEST)
    names = [f.name for f in kind.fields if f.name in manifests.columns]
    kept = T.StructType([kind[n] for n in names])
    return F.to_json(merge_known(F.struct(*names), kept, F.try_parse_json(raw)))
