"""Emotion rules as data: any number of rules, from a table, matched in one pass over each text.

A rule is a row (ord, name, pattern, style, degree_factor) whose pattern is a list of alternatives between word borders, as in
the built-in tables. Every alternative begins with literal words; these go into one Aho-Corasick automaton, which
finds all of them in one pass whatever their number. Where an alternative is more than its literal, a small
pattern verifies it at that place. As in a regular expression, a rule's matches do not overlap, the leftmost counts, and of
alternatives that begin together the first in the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_RULE_BYTES = 64 * 2**20  # of patterns that are sent to tasks
_LOW = {i: i + 32 for i in range(65, 91)}  # case is that of ASCII, so that lengths stay; borders are those of letters of any script
_META = re.compile(r"[.?*+\[\]{}()|\\^$]")
HIT = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def _split(body: str) -> list[str]:
    """Alternatives of a pattern, at bars outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(body[at:i])
            at = i + 1
    return [*out, body[at:]]


class RuleMatcher:
    """An automaton of rules (ord, pattern)."""

    def __init__(self, rules: list[tuple[int, str]]):
        import ahocorasick

        by_literal: dict[str, list[tuple[int, int, re.Pattern | None]]] = {}
        for ord_, pattern in rules:
            body = pattern.removeprefix("(?i)").removeprefix(r"\b").removesuffix(r"\b")
            body = body[1:-1] if body.startswith("(") and body.endswith(")") else body
            for place, alternative in enumerate(_split(body)):
                meta = _META.search(alternative)
                literal = alternative[: meta.start()] if meta else alternative
                if meta and meta[0] in "?*{" and literal:
                    literal = literal[:-1]  # its last letter may be absent
                if not literal:
                    raise ValueError(f"an alternative without literal beginning: {alternative!r}")
                whole = re.compile(rf"\b(?:{alternative})\b", re.I) if meta else None
                by_literal.setdefault(literal.translate(_LOW), []).append((ord_, place, whole))
        self.automaton = ahocorasick.Automaton()
        for literal, uses in by_literal.items():
            self.automaton.add_word(literal, (len(literal), uses))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int]]:
        """(ord, matches) of the rules that match, by ord."""
        if not text or not len(self.automaton):
            return []
        low, found = text.translate(_LOW), {}
        for last, (size, uses) in self.automaton.iter(low):
            start = last + 1 - size
            if start and self._word(low[start - 1]) and self._word(low[start]):
                continue
            end = last + 1
            for ord_, place, whole in uses:
                if whole is not None:
                    m = whole.match(text, start)
                    if m:
                        found.setdefault(ord_, []).append((start, place, m.end()))
                elif (end == len(low) or not self._word(low[end])) and self._word(low[end - 1]) and self._word(low[start]):
                    found.setdefault(ord_, []).append((start, place, end))
        out = []
        for ord_, hits in sorted(found.items()):
            free, n = 0, 0
            for start, _, end in sorted(hits):
                if start >= free:
                    free, n = end, n + 1
            out.append((ord_, n))
        return out

    @staticmethod
    def _word(c: str) -> bool:
        return c.isalnum() or c == "_"


def with_rule_hits(docs: DataFrame, rules: DataFrame, text: str = "text", column: str = "hits") -> DataFrame:
    """``docs`` with an array of (ord, n) of the rules that match each text; ``rules`` is counted before it is sent to tasks.

    Null and empty texts have none.
    """
    size = rules.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0]
    if size > MOST_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules, over {MOST_RULE_BYTES}")
    rows = [(r["ord"], r["pattern"]) for r in rules.select("ord", "pattern").orderBy("ord").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    at, columns = docs.columns.index(text), T.StructType([*docs.schema.fields, T.StructField(column, HIT)])
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = RuleMatcher(shared.value)
        for batch in batches:
            hits = [[{"ord": o, "n": n} for o, n in matcher(t)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], columns.fieldNames())

    return docs.mapInArrow(run, columns)


def rule_counts_by_table(docs: DataFrame, rules: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, ord, name, style, degree_factor, n): one row for each rule that a text matches."""
    hits = with_rule_hits(docs.select(*keys, text), rules, text).select(*keys, F.explode("hits").alias("h")).select(*keys, "h.ord", "h.n")
    about = rules.select("ord", "name", "style", "degree_factor")
    return hits.join(F.broadcast(about), "ord").select(*keys, "ord", "name", "style", "degree_factor", "n")


def best_rule(docs: DataFrame, rules: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The rule of a table with most matches in each text, the earliest on ties; texts without matches have no row."""
    counted = with_rule_hits(docs.select(*keys, text), rules, text)
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["n"].alias("n"), (-h["ord"]).alias("first"))))
    rows = counted.select(*keys, F.explode(F.array(best)).alias("b")).filter("b is not null").select(*keys, (-F.col("b.first")).alias("ord"), F.col("b.n").alias("n"))
    return rows.join(F.broadcast(rules.select("ord", "name", "style", "degree_factor")), "ord").select(*keys, "name", "style", "degree_factor", "n")
