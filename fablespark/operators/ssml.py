"""Speech markup from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.functions import emotion as E
from fablespark.functions.text import clean_web, find_all_spans, let, strip, xml_escape
from fablespark.operators.dialogue import drop_overlaps
from fablespark.operators.voices import resolve_style

# Words that are stressed, inline tags, quote families of the markup builder.
STRESSED = "never|always|only|just|really|so|too|completely|utterly|now|no|desperately|run|time"
TAGS = "sad angry whisper terrified cheerful empathetic sarcastic reflective urgent gentle".split()
QUOTES = ['[“”"]([^"“”]{0,600})[“”"]', "«([^»]{0,600})»", "「([^」]{0,600})」", "『([^』]{0,600})』"]
HEAD = '<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis" xmlns:mstts="http://www.w3.org/2001/mstts" xml:lang="en-US">'


def quotes(text: Column) -> Column:
    """(start, end, said) of the quotes of a cleaned text, without overlaps."""
    return drop_overlaps(F.transform(find_all_spans(text, QUOTES), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), strip(s["groups"][1]).alias("said"))))


def parts(text: Column, kept: Column) -> Column:
    """(text, is_dialogue) of narration and quotes in order; the whole text where neither has content.

    ``kept`` is a column of quotes(text).
    """
    row = lambda t, d: F.filter(F.array(F.struct(t.alias("text"), F.lit(d).alias("is_dialogue"))), lambda r: F.length(r["text"]) > 0)
    cut = lambda i: F.when(i > 0, F.get(kept, i - 1)["end"]).otherwise(0)
    tell = lambda a, b: row(strip(F.substr(text, a + 1, b - a)), False)
    last = F.element_at(F.concat(F.array(F.lit(0)), F.transform(kept, lambda m: m["end"])), -1)
    out = F.concat(F.flatten(F.transform(kept, lambda m, i: F.concat(tell(cut(i), m["start"]), row(m["said"], True)))), tell(last, F.length(text)))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.struct(text.alias("text"), F.lit(False).alias("is_dialogue"))))


def stress_and_pause(escaped: Column) -> Column:
    """Emphasis on stressed words and breaks at punctuation of escaped text."""
    steps = [
        (rf"(?i)\b({STRESSED})\b", '<emphasis level="moderate">$1</emphasis>'),
        (r"([,;:])\s+", '$1 <break time="180ms"/> '),
        (r"([.!?])\s+(?=[A-Z\"'])", '$1 <break time="420ms"/> '),
        (r"([.!?])(?=\s*\z)", '$1 <break time="420ms"/> '),
        (r"—\s*", '— <break time="300ms"/> '),
        (r"--\s*", '— <break time="280ms"/> '),
    ]
    for pattern, replacement in steps:
        escaped = F.regexp_replace(escaped, pattern, replacement)
    return escaped


def _express(style: Column, degree: Column, content: Column) -> Column:
    return F.concat(F.lit('<mstts:express-as style="'), style, F.lit('" styledegree="'), degree, F.lit('">'), content, F.lit("</mstts:express-as>"))


def segment_markup(part: Column, hint: Column, rate: Column, pitch: Column, volume: Column, expressiveness: Column, styles: Column) -> Column:
    """Markup of one (text, is_dialogue) part for a voice with ``styles``."""
    spoken = part["is_dialogue"] | hint
    content = stress_and_pause(xml_escape(part["text"]))
    content = F.when(spoken, F.concat(F.lit('<break time="120ms"/> '), content)).otherwise(content)
    nudge = lambda text, unit: F.format_string(f"%+d{unit}", F.coalesce(F.regexp_extract(text, r"^([+-]?\d+)", 1).cast("int"), F.lit(0)) + 2)
    content = F.concat(
        F.lit('<prosody rate="'), F.when(spoken, nudge(rate, "%%")).otherwise(rate), F.lit('" pitch="'), F.when(spoken, nudge(pitch, "Hz")).otherwise(pitch),
        F.lit('" volume="'), volume, F.lit('">'), content, F.lit("</prosody>"),
    )
    felt = E.detect_emotion(part["text"], expressiveness)
    start = let(felt, lambda f: F.concat(F.lit('<mstts:express-as style="'), resolve_style(styles, f["style"]), F.lit('" styledegree="'), f["degree"], F.lit('">')))
    content = let(start, lambda s: F.when(s.isNotNull(), F.concat(s, content, F.lit("</mstts:express-as>"))).otherwise(content))
    untagged = content
    for tag in TAGS:
        own = resolve_style(styles, F.lit(tag))
        content = F.regexp_replace(content, F.lit(rf"(?i)\[{tag}\]"), F.coalesce(_express(own, F.lit("1.15"), F.lit("")), F.lit("")))
    return F.when(F.contains(part["text"], F.lit("[")), content).otherwise(untagged)


def with_markup(rows: DataFrame, out: str = "ssml", text: str = "text", styles: Column | None = None, style: Column | None = None, expressiveness: Column | None = None, dialogue: Column | None = None, rate: Column | None = None, pitch: Column | None = None, volume: Column | None = None, direction: Column | None = None, bias: Column | None = None) -> DataFrame:
    """rows with expressive markup of their text as ``out``.

    ``styles`` are those of the row's voice (null or empty for none); the other options default to a
    natural style, 0.68, narration, no change of rate, pitch and volume, no direction, no bias.
    """
    given = lambda c, default: c if c is not None else F.lit(default)
    w = rows.select("*", F.coalesce(given(styles, None), F.array().cast("array<string>")).alias("__styles"), given(dialogue, False).alias("__spoken"), clean_web(F.col(text)).alias("__clean"),
                    given(style, "natural").alias("__style"), given(expressiveness, 0.68).cast("double").alias("__e"), E.auto_style(F.col(text)).alias("__auto"))
    take = (F.col("__style") == "auto") | ((F.col("__e") > 0.5) & (F.col("__auto.boost") > 0))
    w = w.withColumns({"__style": F.when(take, F.col("__auto.style")).otherwise(F.col("__style")), "__e": F.when(take, F.least(F.lit(0.95), F.col("__e") + F.col("__auto.boost"))).otherwise(F.col("__e"))})
    for said, rule in ((direction, E.direct), (bias, E.biased)):
        if said is not None:
            w = w.withColumn("__led", rule(F.col("__style"), F.col("__e"), said))
            w = w.withColumns({"__style": F.col("__led.style"), "__e": F.col("__led.expressiveness")})
    zero = F.lit(0.0)
    w = w.withColumns({"__rate": E.percent(E.clamp(F.coalesce(given(rate, 0.0), zero), -0.5, 0.5)), "__pitch": E.signed(given(pitch, 0.0), "Hz"), "__volume": E.signed(given(volume, 0.0), "%")})
    w = w.withColumn("__quotes", quotes(F.col("__clean"))).withColumn("__parts", parts(F.col("__clean"), F.col("__quotes")))
    c = lambda name: F.col(f"__{name}")
    w = w.withColumn("__inner", F.array_join(F.transform(c("parts"), lambda p: segment_markup(p, c("spoken"), c("rate"), c("pitch"), c("volume"), c("e"), c("styles"))), " "))
    has = c("spoken") | F.exists(c("parts"), lambda p: p["is_dialogue"])
    w = w.withColumn("__wrap", resolve_style(c("styles"), E.express_style(c("style"), has, c("e"))))
    local = F.contains(c("inner"), F.lit("mstts:express-as"))
    wrapped = F.when(c("wrap").isNotNull() & (c("e") > 0.30) & (~local | (c("e") > 0.78)), _express(c("wrap"), E.one_decimal(E.wrapper_degree(c("e"))), c("inner"))).otherwise(c("inner"))
    empty = F.lit(HEAD + '<prosody rate="+0%" pitch="+0Hz" volume="+0%">...</prosody></speak>')
    ssml = F.when(F.length(c("clean")) == 0, empty).otherwise(F.concat(F.lit(HEAD), wrapped, F.lit("</speak>")))
    return w.select(*rows.columns, ssml.alias(out))


def basic(text: Column, rate: Column, pitch: Column, volume: Column) -> Column:
    """Plain prosody markup."""
    return F.concat(F.lit(HEAD + '<prosody rate="'), E.percent(E.clamp(rate, -0.5, 0.5)), F.lit('" pitch="'), E.signed(pitch, "Hz"), F.lit('" volume="'), E.signed(volume, "%"), F.lit('">'), xml_escape(clean_web(text)), F.lit("</prosody></speak>"))


def feature_counts(markup: Column) -> Column:
    """(express_as, breaks, emphasis, prosody) tags of a markup."""
    n = lambda tag: F.regexp_count(markup, F.lit(tag)).cast("long")
    return F.struct(n("<mstts:express-as").alias("express_as"), n("<break").alias("breaks"), n("<emphasis").alias("emphasis"), n("<prosody").alias("prosody"))
