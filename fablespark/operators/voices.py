"""Voice catalogue lookups and voice assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablespark.functions.hashing import pick_index
from fablespark.functions.text import let
from fablespark.functions.voice_table import CHARACTER_POOL, STYLE_FALLBACKS, VOICES
from fablespark.operators import paging


def catalogue(spark: SparkSession) -> DataFrame:
    """All voices: id, label, locale, gender, style, expressiveness, recommended_styles, supports_express_as, styles."""
    rows = [(i, l, loc, g, s, e, r.split(), bool(st), st.split()) for i, l, loc, g, s, e, r, st in VOICES]
    return spark.createDataFrame(rows, "id string, label string, locale string, gender string, style string, expressiveness double, recommended_styles array<string>, supports_express_as boolean, styles array<string>")


def page(voices: DataFrame, number: int, size: int = 12) -> DataFrame:
    """One page by (locale, id), the number clamped to the pages there are."""
    return paging.page(voices, ["locale", "id"], number, size)


def supports(styles: Column, style: Column) -> Column:
    return F.coalesce(F.array_contains(styles, F.lower(style)), F.lit(False))


def resolve_style(styles: Column, desired: Column) -> Column:
    """The wanted style if the voice has it, else the first fallback it has, else null."""
    chains = F.create_map(*(x for k, v in STYLE_FALLBACKS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))))

    def pick(want: Column) -> Column:
        order = F.concat(F.array(want), F.coalesce(chains[want], F.array().cast("array<string>")))
        return F.when(~want.isin("natural", "conversational"), F.get(F.filter(order, lambda s: supports(styles, s)), F.lit(0)))

    low = F.lower(desired)
    return let(F.when(low == "whisper", "whispering").otherwise(low), pick)


def pool_voice(name: Column) -> Column:
    """The pool's voice for a character: the same one in every run."""
    return F.element_at(F.array(*map(F.lit, CHARACTER_POOL)), pick_index(name, len(CHARACTER_POOL)) + 1)


def is_narrator(speaker: Column) -> Column:
    return F.coalesce(speaker, F.lit("narrator")).isin("", "narrator")


def assign_voices(segs: DataFrame, given: DataFrame, narrator: str, dialogue: str, auto: bool = True) -> DataFrame:
    """segs with voice: the character's given one, else one of the pool (or ``dialogue`` if not auto).

    A segment whose voice changes goes back to pending and loses its clip, where it has those
    columns. ``given`` holds (speaker, voice), one row for each speaker.
    """
    joined = segs.join(given.select(F.col("speaker").alias("__s"), F.col("voice").alias("__v")), F.col("speaker") == F.col("__s"), "left")
    other = pool_voice(F.col("speaker")) if auto else F.lit(dialogue)
    new = F.when(is_narrator(F.col("speaker")), narrator).otherwise(F.coalesce(F.nullif(F.col("__v"), F.lit("")), other))
    changed = F.coalesce(F.length("voice") > 0, F.lit(False)) & (F.col("voice") != F.col("__new")) if "voice" in segs.columns else F.lit(False)
    joined = joined.withColumn("__new", new).withColumn("__changed", changed)
    reset = {"status": F.lit("pending"), "cache_file": F.lit(None), "duration_seconds": F.lit(None)}
    cols = [F.when(F.col("__changed"), reset[c].cast(t)).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c, t in segs.dtypes if c != "voice"]
    return joined.select(*cols, F.col("__new").alias("voice"))


def merge_maps(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of both, ``over`` winning."""
    o = over.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return base.join(o, F.col(key) == F.col("__k"), "full").select(F.coalesce("__k", key).alias(key), F.coalesce("__v", value).alias(value))
