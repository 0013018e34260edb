"""Dialogue spans, speaker attribution and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.functions.text import clean_speaker, find_all_spans, find_spans, let, sentences, strip

# Verbs that introduce or follow speech, by dialect.
SPEECH_VERBS = "said|asked|whispered|shouted|replied|muttered|called|cried|exclaimed|murmured|growled|snapped|hissed|sighed|laughed|yelled|screamed|pleaded|demanded|insisted|warned|added|continued|began|interrupted|suggested|agreed|admitted|explained|announced|declared|protested|argued|offered|promised|answered|urged|begged"
WEB_VERBS = "said|says|replied|whispered|asked|shouted|muttered|answered|cried|sighed|laughed|called|yelled|gasped|exclaimed|murmured|added|continued|declared|demanded|insisted|responded|hissed|stammered|snapped|growled|barked|groaned|mumbled|chuckled|noted|remarked|scoffed|interrupted|began|confessed"
_Q, _NAME = "[\"“”]", "([A-Z][a-z]+(?:\\s[A-Z][a-z]+)?)"
_SAID = f"{_Q}([^\"“”]+){_Q}"
# Quote families, in order.
QUOTES = [("double", '(?s)"(.+?)"'), ("curly", "(?s)“(.+?)”"), ("guillemet", "(?s)«(.+?)»"), ("german", "(?s)„(.+?)“"), ("cjk_corner", "(?s)「(.+?)」"), ("cjk_double_corner", "(?s)『(.+?)』")]
WEB_NAME = "[A-Z][a-zA-Z'\\-]{1,24}(?:\\s+[A-Z][a-zA-Z'\\-]{1,24})?"
WEB_QUOTES = "“([^”]+)”|\"([^\"\\n]{1,500})\"|«([^»]+)»"


def drop_overlaps(spans: Column) -> Column:
    """By start, longer first, keep each span that begins at or after the end of the last one kept.

    The fold writes one character for each span, so that kept spans are not copied at every step.
    """
    start = F.struct(F.lit(-1).alias("end"), F.lit("").alias("flags"))

    def step(a: Column, s: Column) -> Column:
        free = s["start"] >= a["end"]
        return F.struct(F.when(free, s["span"]["end"]).otherwise(a["end"]).alias("end"), F.concat(a["flags"], F.when(free, "1").otherwise("0")).alias("flags"))

    def keep(ordered: Column) -> Column:
        flags = F.aggregate(ordered, start, step, lambda a: a["flags"])
        return let(flags, lambda f: F.transform(F.filter(ordered, lambda s, i: F.substr(f, i + 1, F.lit(1)) == "1"), lambda s: s["span"]))

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s.alias("span")))), keep)


def _span(s: Column, dialogue: Column, speaker: Column | None, method: str, confidence: float, style: Column) -> Column:
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), dialogue.alias("dialogue"), (speaker if speaker is not None else F.lit(None).cast("string")).alias("speaker"),
        F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), style.cast("string").alias("quote_style"),
    )


ATTRIBUTED = [rf"{_SAID}\s*{_NAME}\s+({SPEECH_VERBS})", rf"{_NAME}\s+({SPEECH_VERBS})\s*,?\s*{_SAID}", rf"{_SAID}\s*{_NAME}\s+({SPEECH_VERBS})\s*,?\s*{_SAID}"]


def attributed_spans(text: Column) -> Column:
    """Quotes with a named speaker: quote-name-verb, name-verb-quote, quote-name-verb-quote."""

    def one(s: Column) -> Column:
        g = lambda i: strip(F.get(s["groups"], F.lit(i)))
        said = F.when(s["which"] == 0, g(1)).when(s["which"] == 1, g(3)).otherwise(F.concat(g(1), F.lit(" ... "), g(4)))
        return _span(s, said, F.when(s["which"] == 1, g(1)).otherwise(g(2)), "regex", 0.95, F.lit(None))

    return drop_overlaps(F.transform(find_all_spans(text, ATTRIBUTED), one))


def quote_spans(text: Column) -> Column:
    """Quotes of all families, without speaker."""
    names = F.array(*(F.lit(n) for n, _ in QUOTES))
    return drop_overlaps(F.transform(find_all_spans(text, [p for _, p in QUOTES]), lambda s: _span(s, strip(s["groups"][1]), None, "quote", 0.35, F.get(names, s["which"]))))


def first_overlap(start: Column, end: Column, spans: Column) -> Column:
    """The first span that overlaps [start, end), or null."""
    return F.get(F.filter(spans, lambda d: (start < d["end"]) & (end > d["start"])), F.lit(0))


def alternate(turns: Column) -> Column:
    """Fill unknown speakers by alternation.

    turns: array of (speaker, ask) in order; a known speaker is remembered. Where ``ask`` and the
    last two remembered speakers differ, the older one is taken, and remembered. Returns the
    speakers (null where none) as an array.
    """
    # The fold remembers turns by their number and writes numbers of ten characters, not names, so little is copied.
    name = lambda k: F.get(turns, k)["speaker"]
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), none.alias("a"), none.alias("b"), F.lit("").alias("out"))

    def step(s: Column, t: Column) -> Column:
        guess = F.when(t["ask"] & (name(s["a"]) != name(s["b"])), s["b"])
        who = F.when(t["speaker"].isNotNull(), s["i"]).otherwise(guess)
        return F.struct((s["i"] + 1).alias("i"), F.coalesce(who, s["a"]).alias("a"), F.when(who.isNotNull(), s["a"]).otherwise(s["b"]).alias("b"), F.concat(s["out"], F.format_string("%10d", F.coalesce(who, F.lit(-1)))).alias("out"))

    def names(out: Column) -> Column:
        number = lambda i: F.ltrim(F.substr(out, 10 * i + 1, F.lit(10))).cast("int")
        return F.transform(turns, lambda t, i: let(number(i), lambda k: F.when(k >= 0, name(k))))

    return let(F.aggregate(turns, start, step, lambda s: s["out"]), names)


def detect_dialogue(chapters: DataFrame, keys: list[str], strategy: str = "auto", entities: DataFrame | None = None) -> DataFrame:
    """keys + start, end, dialogue, speaker, method, confidence, quote_style of each span.

    ``keys`` name one chapter each; chapters that share them would be read as one.

    ``strategy`` is auto, regex_only or quotes_only. ``entities`` (keys, name, position) are person
    names found elsewhere; the nearest within 500 characters of an unattributed quote speaks it.
    """
    text = F.col("text")
    if strategy != "auto":
        spans = attributed_spans(text) if strategy == "regex_only" else quote_spans(text)
        return chapters.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.*")
    found = chapters.select(*keys, quote_spans(text).alias("__q"), attributed_spans(text).alias("__r"))
    known = F.transform("__q", lambda q: F.struct(q.alias("q"), first_overlap(q["start"], q["end"], F.col("__r"))["speaker"].alias("named")))
    quotes = found.select(*keys, F.posexplode(known).alias("ord", "k")).select(*keys, "ord", "k.q", "k.named")
    quotes = nearest_entity(quotes, entities, keys) if entities is not None else quotes.withColumn("entity", F.lit(None).cast("string"))
    rows = quotes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "q", "named", "entity"))).alias("all"))
    rows = rows.withColumn("who", alternate(F.transform("all", lambda r: F.struct(F.coalesce(r["named"], r["entity"]).alias("speaker"), F.lit(True).alias("ask")))))
    out = rows.select(*keys, F.posexplode("all").alias("i", "r"), "who").withColumn("speaker", F.get("who", "i"))
    pick = lambda a, b, c, d: F.when(F.col("r.named").isNotNull(), a).when(F.col("r.entity").isNotNull(), b).when(F.col("speaker").isNotNull(), c).otherwise(d)
    return out.select(*keys, "r.q.start", "r.q.end", "r.q.dialogue", "speaker", pick("regex", "spacy", "alternation", "unattributed").alias("method"), pick(0.95, 0.7, 0.55, 0.2).alias("confidence"), "r.q.quote_style")


def nearest_entity(quotes: DataFrame, entities: DataFrame, keys: list[str], reach: int = 500, width: int = 2048) -> DataFrame:
    """quotes with the name nearest to their start within ``reach`` of them, as ``entity`` (null where named).

    Positions are cut into cells of ``width``: a name lies in one, a quote asks those that its reach touches. So the
    join is an equi-join on (keys, cell), and a chapter's names are not compared with all of its quotes. Of
    names equally near the first in the text counts. Null keys are equal to each other.
    """
    row = quotes.select(F.struct(*quotes.columns).alias("__row"), F.monotonically_increasing_id().alias("__id"), *(F.col(k).alias(f"__l{i}") for i, k in enumerate(keys)))
    start, end = F.col("__row.q.start"), F.col("__row.q.end")
    cells = F.sequence(F.floor((start - reach) / width), F.floor((end + reach - 1) / width))
    asking = row.withColumn("__cell", F.explode(F.when(F.col("__row.named").isNull(), cells).otherwise(F.array(F.lit(None).cast("long")))))
    names = entities.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.floor(F.col("position") / width).alias("__own"), F.col("name").alias("__name"), F.col("position").alias("__pos"))
    on = (F.col("__cell") == F.col("__own")) & (F.col("__pos") >= start - reach) & (F.col("__pos") < end + reach)
    for i in range(len(keys)):
        on = on & F.col(f"__l{i}").eqNullSafe(F.col(f"__k{i}"))
    best = F.min_by("__name", F.when(F.col("__pos").isNotNull(), F.struct(F.abs(F.col("__pos") - start), F.col("__pos"), F.col("__name"))))
    found = asking.join(names, on, "left").groupBy("__id").agg(F.first("__row").alias("__row"), strip(best).alias("entity"))
    return found.select("__row.*", "entity")


def interval_first(left: DataFrame, right: DataFrame, keys: list[str], value: list[str], width: int = 4096) -> DataFrame:
    """left outer join of half-open intervals on keys, keeping the first right interval that overlaps.

    Both sides carry start and end. Intervals are cut into cells of ``width``, so the join is an
    equi-join on (keys, cell) and a long chapter is not compared with itself as a whole. Repeated
    rows stay apart, and null keys are equal to each other.
    """
    cell = lambda df: df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))))
    numbered = left.select(F.struct(*left.columns).alias("__row"), F.monotonically_increasing_id().alias("__id"), "start", "end", *(F.col(k).alias(f"__l{i}") for i, k in enumerate(keys)))
    b = cell(right.select(*keys, "start", "end", *value)).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("__cell").alias("__rcell"), F.struct(*value).alias("__v"))
    on = (F.col("__cell") == F.col("__rcell")) & (F.col("start") < F.col("__e")) & (F.col("end") > F.col("__s"))
    for i in range(len(keys)):
        on = on & F.col(f"__l{i}").eqNullSafe(F.col(f"__k{i}"))
    best = cell(numbered).join(b, on, "left").groupBy("__id").agg(F.first("__row").alias("__row"), F.min_by("__v", F.when(F.col("__s").isNotNull(), F.struct("__s", "__e"))).alias("__v"))
    return best.select("__row.*", *(F.col(f"__v.{v}").alias(v) for v in value))


def attribute_segments(segs: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """segs with speaker, speaker_method, speaker_confidence.

    The first overlapping span with a speaker gives it; else a segment with double quotes takes the
    older of the last two speakers of its epoch; else the narrator speaks. ``keys`` name one chapter each.
    """
    named = spans.filter(F.col("speaker").isNotNull()).select(*keys, "start", "end", strip(F.col("speaker")).alias("__who"), F.col("method").alias("__how"), F.col("confidence").alias("__sure"))
    joined = interval_first(segs, named, keys, ["__who", "__how", "__sure"])
    rows = joined.groupBy(*keys, "epoch").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.struct(*joined.columns).alias("r")))).alias("all"))
    asks = F.transform("all", lambda x: F.struct(x["r"]["__who"].alias("speaker"), x["r"]["text"].rlike("[\"“”]").alias("ask")))
    out = rows.select("all", alternate(asks).alias("who")).select(F.posexplode("all").alias("i", "x"), "who").select("x.r.*", F.get("who", "i").alias("__speaker"))
    pick = lambda a, b, c: F.when(F.col("__who").isNotNull(), a).when(F.col("__speaker").isNotNull(), b).otherwise(c)
    return out.select(*segs.columns, F.coalesce("__speaker", F.lit("narrator")).alias("speaker"), pick(F.col("__how"), F.lit("alternation_span"), F.lit("narration")).alias("speaker_method"), pick(F.col("__sure"), F.lit(0.45), F.lit(0.2)).alias("speaker_confidence"))


def context_speaker(before: Column, after: Column) -> Column:
    """Web dialect: a name before or after a speech verb in the text around a quote."""
    scope = F.concat(F.coalesce(before, F.lit("")), F.lit(" "), F.coalesce(after, F.lit("")))
    pre = F.regexp_extract(scope, rf"({WEB_NAME})\s+(?:{WEB_VERBS})\b", 1)
    post = F.regexp_extract(scope, rf"\b(?:{WEB_VERBS})\s+({WEB_NAME})", 1)
    return F.coalesce(clean_speaker(F.nullif(pre, F.lit(""))), clean_speaker(F.nullif(post, F.lit(""))))


def chunk_paragraph(body: Column, found: Column) -> Column:
    """Web dialect: (text, is_dialogue, speaker) of a paragraph's narration sentences and quotes.

    ``body`` is a trimmed column, ``found`` a column of find_spans(body, WEB_QUOTES).
    """
    cut = lambda i: F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0)
    row = lambda t, d, s: F.struct(t.alias("text"), F.lit(d).alias("is_dialogue"), s.alias("speaker"))
    none = F.lit(None).cast("string")
    tell = lambda a, b: F.transform(sentences(F.substr(body, a + 1, b - a), "web"), lambda s: row(s, False, none))

    def quote(m: Column, i: Column) -> Column:
        said = strip(F.coalesce(m["groups"][1], m["groups"][2], m["groups"][3]))
        left = F.greatest(F.lit(0), m["start"] - 80)
        who = context_speaker(F.substr(body, left + 1, m["start"] - left), F.substr(body, m["end"] + 1, F.lit(80)))
        return F.concat(tell(cut(i), m["start"]), F.filter(F.array(row(said, True, who)), lambda r: F.length(r["text"]) > 0))

    last = F.when(F.size(found) > 0, F.element_at(F.concat(F.array(F.lit(0)), F.transform(found, lambda m: m["end"])), -1)).otherwise(0)
    return F.concat(F.flatten(F.transform(found, quote)), tell(last, F.length(body)))


def merge_tiny(chunks: Column, most: int = 280) -> Column:
    """Neighbours of one kind and speaker joined while they stay within ``most`` characters."""
    # the fold finds where pieces begin; they are joined once after it
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(-1).alias("size"), F.lit(None).cast("boolean").alias("kind"), none.alias("who"), F.lit("").alias("flags"))

    def step(a: Column, c: Column) -> Column:
        grown = a["size"] + F.length(c["text"]) + 1
        fits = F.coalesce((a["size"] >= 0) & (a["kind"] == c["is_dialogue"]) & a["who"].eqNullSafe(c["speaker"]) & (grown <= most), F.lit(False))
        return F.struct(F.when(fits, grown).otherwise(F.length(c["text"])).alias("size"), c["is_dialogue"].alias("kind"), c["speaker"].alias("who"), F.concat(a["flags"], F.when(fits, "0").otherwise("1")).alias("flags"))

    def pieces(flags: Column) -> Column:
        begin = F.filter(F.transform(chunks, lambda c, i: F.when(F.substr(flags, i + 1, F.lit(1)) == "1", i)), lambda i: i.isNotNull())

        def piece(at: Column, k: Column, all_: Column) -> Column:
            own = F.slice(chunks, at + 1, F.coalesce(F.get(all_, k + 1), F.size(chunks)) - at)
            return F.struct(F.array_join(F.transform(own, lambda c: c["text"]), " ").alias("text"), F.get(chunks, at)["is_dialogue"].alias("is_dialogue"), F.get(chunks, at)["speaker"].alias("speaker"))

        return let(begin, lambda all_: F.transform(all_, lambda at, k: piece(at, k, all_)))

    return let(F.aggregate(chunks, start, step, lambda a: a["flags"]), pieces)


def chunks_web(chapters: DataFrame, keys: list[str], most: int = 280) -> DataFrame:
    """Web dialect: keys + index, text, is_dialogue, speaker of every chapter's chunks, small ones merged."""
    paras = F.split("text", r"\n{2,}")
    made = chapters.select(*keys, F.posexplode(paras).alias("__p", "__t")).select(*keys, "__p", strip(F.col("__t")).alias("__t"))
    made = made.withColumn("__found", find_spans(F.col("__t"), WEB_QUOTES)).select(*keys, "__p", chunk_paragraph(F.col("__t"), F.col("__found")).alias("__c"))
    rows = made.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__p", "__c"))).alias("all"))
    rows = rows.withColumn("merged", merge_tiny(F.flatten(F.transform("all", lambda x: x["__c"])), most))
    return rows.select(*keys, F.posexplode("merged").alias("index", "c")).select(*keys, "index", "c.*")


def speaker_counts(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Named speakers by number of chunks, first seen first on ties."""
    return chunks.filter(F.length("speaker") > 0).groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")).orderBy(F.desc("n"), "first").select(F.col("speaker").alias("name"), F.col("n").alias("count"))
