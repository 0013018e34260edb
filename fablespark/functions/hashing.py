"""Content hashes that name cached results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_VERSION = 3


def text_hash(text: Column, voice: Column, engine: Column, speed: Column) -> Column:
    return F.md5(F.concat_ws("|", text, voice, engine, speed.cast("double").cast("string")))


def cache_key(text: Column, voice: Column, engine: Column, speed: Column, pronunciation: Column | None = None, mode: Column | None = None, style: Column | None = None, expressiveness: Column | None = None, role: Column | None = None, bias: Column | None = None) -> Column:
    """Key of a synthesized clip; the speed counts only where the engine applies it."""
    blank = lambda c, default="": F.coalesce(F.nullif(c, F.lit("")), F.lit(default)) if c is not None else F.lit(default)
    mode = mode if mode is not None else F.lit("native")
    effective = F.when(mode == "native", speed.cast("double")).otherwise(F.lit(1.0)).cast("string")
    exp = F.format_string("%.2f", expressiveness.cast("double") if expressiveness is not None else F.lit(0.0))
    return F.md5(F.concat(
        F.lit(f"v={KEY_VERSION}|"), text, F.lit("|"), voice, F.lit("|"), engine, F.lit("|"), effective, F.lit("|"), blank(pronunciation), F.lit("|"), mode,
        F.lit("|style="), blank(style, "default"), F.lit("|exp="), exp, F.lit("|role="), blank(role), F.lit("|ebias="), blank(bias),
    ))


def map_hash(entries: Column) -> Column:
    """MD5 of a string map as JSON with sorted keys and ', ' / ': ' between parts."""
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.expr("1") if c is None else F.substring(quoted(c), 2, 1_000_000)
    part = lambda e: F.concat(F.rtrim(inner(e["key"]), F.lit("]")), F.lit(": "), F.rtrim(inner(e["value"]), F.lit("]")))
    return F.md5(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(entries)), part), ", "), F.lit("}")))


def pick_index(name: Column, n: int = 12) -> Column:
    """The name's MD5 as a number, modulo n, from two halves of the digest."""
    digest = F.md5(name)
    part = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("long") % F.lit(n)
    total = part(1)
    for a in (9, 17, 25):
        total = (total * F.lit(pow(16, 8, n)) + part(a)) % F.lit(n)
    return total.cast("int")


def content_signature(text: Column) -> Column:
    """Ten hex digits for a text's first 2,000 characters, 'empty' where there are none."""
    return F.when(F.length(text) > 0, F.substring(F.md5(F.substring(text, 1, 2000)), 1, 10)).otherwise("empty")


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)
