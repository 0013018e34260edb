"""Emotion rules, cues and style arithmetic."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablespark.functions.text import let

# Rule name, word pattern, style, factor. The web dialect has all nine of the first list.
RULES_WEB = [
    ("sad", r"\b(sad|sorrow|grief|tears|heartbroken|weep|wept|mourn|mournful|despair|lonely|melancholy|tragically|devastated|funeral|loss|cried|grieving)\b", "sad", 1.15),
    ("angry", r"\b(angry|anger|furious|rage|raged|hate|hatred|shouted|snapped|growled|snarled|damn|bastard|hell|enraged|outraged|furiously|curse)\b", "angry", 1.22),
    ("excited", r"\b(excited|thrilled|amazing|wonderful|joy|ecstatic|fantastic|yay|hurrah|cheered|exhilarated|delighted|joyfully|magnificent)\b", "cheerful", 1.28),
    ("whisper", r"\b(whisper|whispered|softly|quietly|hushed|secret|murmur|muttered|under (his|her|their) breath|confided)\b", "whisper", 0.78),
    ("fear", r"\b(fear|terrified|scared|afraid|trembled|panic|panicked|horror|dread|shudder|afraid|terror)\b", "terrified", 1.1),
    ("laugh", r"\b(laugh|laughed|laughing|chuckle|chuckled|giggled|hilarious|funny|joked|roared with laughter)\b", "cheerful", 0.9),
    ("gentle", r"\b(gently|soft|warmly|tender|caressed|smiled softly|kindly|lovingly)\b", "empathetic", 0.95),
    ("ecstatic", r"\b(ecstatic|ecstasy|bliss|rapture|overjoyed|jubilant|elated)\b", "cheerful", 1.35),
    ("betrayal", r"\b(betray|betrayal|treason|backstab|deceive|heartbreak|devastated)\b", "sad", 1.25),
]
RULES_DESKTOP = RULES_WEB[:7]
# The rules of the shared data file, where they differ from the web's, and two more.
RULES_DATA = [
    ("sad", r"\b(sad|sorrow|grief|tears|heartbroken|weep|wept|mourn|mournful|despair|lonely|melancholy|tragically|devastated|funeral|loss|cried|grieving|sobbed|sob|sobbing|pleaded|plead|begged)\b", "sad", 1.15),
    ("angry", r"\b(angry|anger|furious|rage|raged|hate|hatred|shouted|snapped|growled|snarled|damn|bastard|hell|enraged|outraged|furiously|curse|hissed|hiss|roared(?! with laughter)|screamed|scream|yelled|yell|demanded)\b", "angry", 1.22),
    *RULES_WEB[2:4],
    ("fear", r"\b(fear|terrified|scared|afraid|trembled|panic|panicked|horror|dread|shudder|afraid|terror|gasped|gasp)\b", "terrified", 1.1),
    *RULES_WEB[5:8],
    ("betrayal", r"\b(betray|betrayal|treason|backstab|deceive|heartbreak|devastated|betrayed|double.?crossed)\b", "sad", 1.25),
    ("sarcastic", r"\b(sarcastically|dryly|with a smirk|yeah right|as if|eye.?roll|scoffed)\b", "angry", 0.82),
    ("intense", r"\b(despite|desperately|frantically|urgently|Suddenly)\b", "angry", 1.12),
]
RULES = {"web": RULES_WEB, "desktop": RULES_DESKTOP, "data": RULES_DATA}


def rules_table(spark: SparkSession, dialect: str = "web") -> DataFrame:
    rows = [(dialect, i, *r) for i, r in enumerate(RULES[dialect])]
    return spark.createDataFrame(rows, "dialect string, ord int, name string, pattern string, style string, degree_factor double")


def _stems(pattern: str) -> list[str]:
    """For each alternative of a rule, literal text that every match holds."""
    inner = re.sub(r"\(\?!?[^)]*\)", "", pattern.removeprefix(r"\b(").removesuffix(r")\b"))
    inner = re.sub(r"\([^)]*\)", "*", inner)
    return [max(re.split(r"[^a-z ]+", w.lower()), key=len) for w in inner.split("|")]


def rule_counts(text: Column, dialect: str = "web") -> Column:
    """Array of (matches, -ord, name, style, factor), one for each rule.

    A rule's pattern runs only on texts that hold one of its words, which a plain search tells.
    """

    def counts(low: Column) -> Column:
        def one(i: int, r: tuple) -> Column:
            any_ = functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in _stems(r[1])))
            n = F.when(any_, F.regexp_count(text, F.lit("(?i)" + r[1]))).otherwise(0)
            return F.struct(n.alias("n"), F.lit(-i).alias("first"), F.lit(r[0]).alias("name"), F.lit(r[2]).alias("style"), F.lit(r[3]).alias("factor"))

        return F.array(*(one(i, r) for i, r in enumerate(RULES[dialect])))

    return let(F.lower(text), counts)


def detect_emotion(text: Column, expressiveness: Column, dialect: str = "web") -> Column:
    """(name, style, degree) of the rule with most matches, the earliest on ties; null if none or too flat."""

    def pick(best: Column) -> Column:
        degree = F.greatest(F.lit(0.4), F.least(F.lit(1.9), best["factor"] * (0.6 + expressiveness * 0.85)))
        good = (F.length(text) > 0) & (expressiveness >= 0.2) & (best["n"] > 0)
        return F.when(good, F.struct(best["name"].alias("name"), best["style"].alias("style"), one_decimal(degree).alias("degree")))

    return let(F.array_max(rule_counts(text, dialect)), pick)


def one_decimal(x: Column) -> Column:
    """Like printing a double with one decimal: exact ties are rare, so half-up on the true value."""
    return F.format_string("%.1f", F.bround(x.cast("decimal(20,15)"), 1).cast("double"))


# Cues of each style, in the order they are tried.
CUES = [
    ("ecstatic", ["amazing", "incredible", "best ever", "fantastic", "ecstatic", "!"]),
    ("excited", ["excited", "can't wait", "wow", "suddenly", "!"]),
    ("sarcastic", ["sure", "yeah right", "of course", "as if"]),
    ("whispering", ["whisper", "quietly", "don't tell", "secret"]),
    ("sad", ["sad", "sorry", "cried", "whispered", "trembling", "lost"]),
    ("angry", ["angry", "furious", "shouted", "how dare", "never"]),
    ("gentle", ["softly", "gently", "warm", "calm", "whispered"]),
    ("intense", ["suddenly", "everything changed", "desperately", "now!"]),
]


def auto_style(text: Column) -> Column:
    """(style, boost): the first style with a cue in the text, then what its marks say."""

    def judge(low: Column) -> Column:
        cue = F.lit("natural")
        for style, words in reversed(CUES):
            cue = F.when(functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in words)), style).otherwise(cue)
        return F.struct(cue.alias("cue"), (F.length(low) - F.length(F.replace(low, F.lit("!"), F.lit("")))).alias("calls"), F.contains(low, F.lit("?")).alias("asks"))

    def result(j: Column) -> Column:
        style = F.when(j["calls"] > 1, "excited").when(j["asks"] & (j["cue"] == "natural"), "conversational").otherwise(j["cue"])
        boost = F.when(j["cue"] != "natural", 0.15).otherwise(0.0) + F.when(j["calls"] > 1, 0.1).otherwise(0.0)
        return F.struct(style.alias("style"), F.least(F.lit(0.3), boost).alias("boost"))

    return let(let(F.lower(F.coalesce(text, F.lit(""))), judge), result)


# Keywords of a voice direction with their boosts, in order, and which set the style.
DIRECTIONS = [("whisper", 0.10), ("whispering", 0.10), ("intense", 0.12), ("dramatic", 0.09), ("angry", 0.13), ("furious", 0.12), ("sad", 0.09), ("excited", 0.11), ("ecstatic", 0.13), ("gentle", 0.07), ("terrified", 0.10), ("fear", 0.09), ("cheerful", 0.10), ("empathetic", 0.08), ("sarcastic", 0.06), ("reflective", 0.05), ("urgent", 0.07), ("calm", 0.03)]
DIRECTION_STYLES = ["whisper", "angry", "sad", "cheerful", "empathetic", "terrified", "intense", "dramatic"]
# Boosts of a speaker's bias, and biases that set the style.
BIASES = {"cheerful": 0.12, "excited": 0.15, "dramatic": 0.10, "intense": 0.14, "calm": 0.02, "empathetic": 0.06, "sad": 0.05, "whispering": 0.03, "sarcastic": 0.04}
BIAS_STYLES = ["cheerful", "empathetic", "dramatic", "intense", "calm", "sad", "excited", "whispering", "sarcastic", "reflective"]


def direct(style: Column, expressiveness: Column, direction: Column) -> Column:
    """(style, expressiveness) after a free-text voice direction."""
    low = F.lower(F.coalesce(direction, F.lit("")))
    named = lambda key: F.lit(None).cast("string") if key not in DIRECTION_STYLES else F.lit("whispering" if key == "whisper" else key)
    rules = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("boost"), named(k).alias("style")) for k, v in DIRECTIONS))

    # a fold, as nested conditions would hold all those before twice each
    def step(a: Column, r: Column) -> Column:
        here = F.contains(low, r["key"])
        own = F.when(here & r["style"].isNotNull() & a["style"].isin("auto", "natural"), r["style"]).otherwise(a["style"])
        return F.struct(own.alias("style"), F.when(here, F.least(F.lit(0.96), a["expressiveness"] + r["boost"])).otherwise(a["expressiveness"]).alias("expressiveness"))

    return F.aggregate(rules, F.struct(style.cast("string").alias("style"), expressiveness.cast("double").alias("expressiveness")), step)


def biased(style: Column, expressiveness: Column, bias: Column) -> Column:
    """(style, expressiveness) after a speaker's emotion bias."""
    b = F.trim(F.lower(F.coalesce(bias, F.lit(""))))
    boost = F.lit(None).cast("double")
    for key, value in BIASES.items():
        boost = F.when(b == key, value).otherwise(boost)
    style = F.when(style.isin("auto", "natural") & b.isin(*BIAS_STYLES), b).otherwise(style)
    return F.struct(style.alias("style"), F.when(boost.isNotNull(), F.least(F.lit(0.96), expressiveness + boost)).otherwise(expressiveness).alias("expressiveness"))


# Express-as style for narration and for dialogue.
EXPRESS = {"natural": (None, None), "dramatic": ("narration-professional", "cheerful"), "conversational": ("friendly", "friendly"), "gentle": ("empathetic", "empathetic"), "intense": ("angry", "terrified"), "excited": ("cheerful", "excited"), "sad": ("sad", "empathetic"), "calm": ("calm", "gentle")}


def express_style(style: Column, dialogue: Column, expressiveness: Column) -> Column:
    key, out = F.lower(F.coalesce(style, F.lit("natural"))), F.lit(None).cast("string")
    for name, (base, spoken) in EXPRESS.items():
        if base:
            out = F.when(key == name, F.when(dialogue, F.lit(spoken)).otherwise(F.lit(base))).otherwise(out)
    return F.when(expressiveness >= 0.35, out)


def wrapper_degree(expressiveness: Column) -> Column:
    return F.greatest(F.lit(0.6), F.least(F.lit(1.9), expressiveness * 1.6))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def percent(x: Column) -> Column:
    """A signed whole percentage, '+0%' for none."""
    return F.format_string("%+d%%", F.floor(x * 100 + 0.5).cast("long"))


def signed(x: Column, unit: str) -> Column:
    number = F.when(x == F.floor(x), F.format_string("%+d", F.floor(x).cast("long"))).otherwise(F.concat(F.when(x > 0, "+").otherwise(""), x.cast("string")))
    return F.concat(F.when(F.coalesce(x, F.lit(0.0)) == 0, "+0").otherwise(number), F.lit(unit))


def provider_settings(style: Column, expressiveness: Column) -> Column:
    """(stability, similarity_boost, style, use_speaker_boost) for the paid provider."""
    given = F.when(F.coalesce(expressiveness, F.lit(0.0)) == 0, 0.5).otherwise(expressiveness)
    e, s = clamp(given, 0.0, 1.0), F.lower(F.coalesce(style, F.lit("natural")))
    steady, extra = clamp(0.78 - e * 0.58, 0.18, 0.92), e * 0.72
    strong, mild = s.isin("dramatic", "intense", "excited"), s.isin("gentle", "calm", "conversational")
    extra = F.when(strong, F.least(F.lit(1.0), extra + 0.22)).when(mild, F.greatest(F.lit(0.03), extra - 0.18)).otherwise(extra)
    steady = F.when(strong, F.greatest(F.lit(0.12), steady - 0.08)).when(mild, F.least(F.lit(0.88), steady + 0.08)).otherwise(steady)
    low, high = steady, extra
    for least, floor, down, up in ((0.50, 0.12, 0.04, 0.05), (0.68, 0.08, 0.10, 0.12), (0.82, 0.05, 0.18, 0.20)):
        low = F.when(e >= least, F.greatest(F.lit(floor), steady - down)).otherwise(low)
        high = F.when(e >= least, F.least(F.lit(1.0), extra + up)).otherwise(high)
    low = F.when((s == "auto") & (e > 0.75), F.greatest(F.lit(0.05), low - 0.05)).otherwise(low)
    return F.struct(F.round(low, 2).alias("stability"), F.lit(0.82).alias("similarity_boost"), F.round(clamp(high, 0.0, 1.0), 2).alias("style"), F.lit(True).alias("use_speaker_boost"))


def generation_seconds(chars: Column, engine: Column) -> Column:
    return F.floor(chars / F.when(engine == "edge-tts", 28).otherwise(16)).cast("long")


def mock_duration(text: Column) -> Column:
    return clamp(F.length(text) / 55.0, 1.0, 8.0)


def tempo_filter(speed: Column) -> Column:
    """A chain of tempo factors within [0.5, 2]; 'anull' for no change; an error at zero or below."""
    ok = F.when(speed > 0, speed.cast("double")).otherwise(F.raise_error(F.lit("Speed multiplier must be > 0")).cast("double"))
    up = F.greatest(F.ceil(F.log2(ok) - 1), F.lit(0)).cast("int")
    down = F.greatest(F.ceil(-F.log2(ok) - 1), F.lit(0)).cast("int")
    rest = ok / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    show = F.rtrim(F.rtrim(F.format_string("atempo=%.6f", rest), F.lit("0")), F.lit("."))
    chain = F.concat(F.array_repeat(F.lit("atempo=2"), up), F.array_repeat(F.lit("atempo=0.5"), down), F.when(F.abs(rest - 1.0) > 0.0001, F.array(show)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(chain) == 0, "anull").otherwise(F.array_join(chain, ","))
