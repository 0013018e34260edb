"""Conversation structure repair by signature deduplication.

Every turn of a conversation is one letter: its role's initial, and whether the turn is sound,
truncated, or must go (blank, or a repetition). The letters in order of turns are the conversation's
signature. Conversations of equal signature need equal edits, so each distinct signature is solved once;
the audits (strings of edits) are joined back and replayed over the turns.

An audit is the cheapest sequence of edits that gives role initials ``(s?(ua)+)?``: Keep 0, Rerole to
user or assistant 3, Delete 4 (the only edit of a turn that must go), Insert of an empty user or assistant turn 3;
a truncated turn that stays adds 3. The least cost from each (place, state) on is a memoised recursion,
filled from the end so that its depth does not grow; of equal costs the ASCII-least audit is taken.

Scale: one shuffle of digests finds repetitions, one of letters makes signatures, one of texts replays
the edits. In the last two, conversations are streams of sorted rows, held as one letter for each turn,
so a conversation of any length needs no group in memory; its hash and audit are sequential by nature, so it is
one task's stream. Signatures that over a thousandth of the conversations share (a thousand at
most) are joined by broadcast, so that no hot signature meets in one task; the others by a shuffle.

Edge cases: null role and text are one space, so such turns are blank; null turns come first and count in no gap;
turns of one number are ordered by a digest of role and text, copies adjacent; a null conversation id is one conversation;
roles count by their first character, and one that is empty or has another initial can only be given a role or go;
extra columns are ignored; an empty table gives no rows; a conversation without rows keeps a row of zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._spark import staged, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SOUND, BLANK, DUPLICATE, CUT, ABSENT = range(5)  # what is wrong with a turn; ABSENT keeps a conversation whose turns are gone
_LETTERS = "suao"  # the initials, and any other; capitals are truncated turns, x must go
_NEVER = 1 << 40
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
_AFTER_INSERT = (2, 2, 3, 2)  # states: nothing yet, after system, after user, after assistant
_AFTER_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
HEAVY = 1000  # at most so many signatures are broadcast
_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, absent): the table with the damage that each row's CRC-32 asks for; dropped rows are absent."""
    conv = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    text = F.when(hurt == 1, "").when(hurt == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(hurt == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conv.select("conv_id", "turn", F.when(hurt == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (hurt == 0).alias("absent"))


def classified(turns: DataFrame) -> DataFrame:
    """``turns`` with tie (a digest of role and text), initial (0 to 3) and fault; turns is (conv_id, turn, role, text, copy, absent)."""
    tie = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    initial = F.coalesce(F.nullif(F.instr(F.lit(_LETTERS[:3]), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.length("role") == 0, 3).otherwise(initial)
    fault: Column = F.when(F.col("absent"), ABSENT).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND)
    return turns.select("*", tie.alias("tie"), initial.cast("int").alias("initial"), fault.cast("int").alias("fault"))


def _codes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, copy, code) of classified rows: narrow, with repetitions found among the turns of equal digest."""
    narrow = rows.select("conv_id", "turn", "tie", "copy", "initial", "fault")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "tie", F.col("fault") == ABSENT).orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(earlier & F.col("fault").isin(SOUND, CUT), DUPLICATE).otherwise(F.col("fault"))
    return narrow.select("conv_id", "turn", "tie", "copy", (F.col("initial") * 8 + fault).cast("int").alias("code"))


def _runs(column: pa.Array) -> np.ndarray:
    """Where a new value begins in a column of sorted values; null is a value."""
    if len(column) < 2:
        return np.zeros(min(len(column), 1), np.int64)
    same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    null = column.is_null().to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(~(same | (null[1:] & null[:-1]))) + 1]


class _Conversation:
    """What a stream of a conversation's turns, in order, amounts to."""

    def __init__(self, key):
        self.key, self.letters = key, []
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.before = -1  # initial of the turn before
        self.count = np.zeros(5, np.int64)

    def add(self, turns: pa.Array, code: np.ndarray) -> None:
        here = code % 8 != ABSENT
        code = code[here]
        if not len(code):
            return
        initial, fault = code // 8, code % 8
        self.count += np.bincount(fault, minlength=5)
        pairs = np.r_[[self.before] if self.before >= 0 else [], initial].astype(int)
        self.illegal += int((~_LEGAL[pairs[:-1], pairs[1:]]).sum())
        self.before = int(initial[-1])
        alphabet = np.frombuffer((_LETTERS + _LETTERS.upper() + "x").encode(), np.uint8)
        self.letters.append(alphabet[np.where((fault == BLANK) | (fault == DUPLICATE), 8, initial + 4 * (fault == CUT))].tobytes())
        numbers = turns.filter(pa.array(here)).drop_null().to_numpy(zero_copy_only=False)
        if len(numbers):
            self.distinct += int((np.diff(numbers) != 0).sum()) + int(self.last is None or numbers[0] != self.last)
            self.first = int(numbers[0]) if self.first is None else self.first
            self.last = int(numbers[-1])

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return self.key, b"".join(self.letters).decode(), gaps, *(int(self.count[k]) for k in (BLANK, DUPLICATE, CUT)), self.illegal


def _signatures(codes: DataFrame, kind: T.DataType) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of every conversation."""
    columns = T.StructType([T.StructField("conv_id", kind), T.StructField("signature", T.StringType()), *(T.StructField(c, T.LongType()) for c in _STATS)])
    names = columns.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, key_type = None, [], None

        def out() -> pa.RecordBatch:
            cells = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cells[0], key_type), pa.array(cells[1], pa.string()), *(pa.array(c, pa.int64()) for c in cells[2:])], names)

        for batch in batches:
            key, turn, code = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            key_type = key.type
            edges = np.r_[_runs(key), len(key)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = key[a].as_py()
                if now is None or now.key != own:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(own)
                now.add(turn[a:b], code[a:b])
            if len(done) > 2000:
                yield out()
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield out()

    ordered = codes.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "tie", "copy")
    return ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), "code").mapInArrow(run, columns)


def _edits(letter: str, state: int, rest: list[int]) -> Iterator[tuple[str, int, int]]:
    """(edit, cost with the rest, state after) of the edits of one turn, in ASCII order."""
    yield "D", DELETE + rest[state], state
    if letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        to = _AFTER_KEEP[letter.lower()][state]
        if to is not None:
            yield "K", more + rest[to], to
        to = _AFTER_INSERT[state]
        yield "R", REROLE + more + rest[to], to


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the ASCII-least of equal ones."""

    def with_inserts(cost: list[int]) -> list[int]:
        user = min(cost[2], INSERT + cost[3])
        return [min(cost[0], INSERT + user), min(cost[1], INSERT + user), user, min(cost[3], INSERT + cost[2])]

    least = [with_inserts([0, _NEVER, _NEVER, 0])]
    for letter in reversed(signature):
        least.append(with_inserts([min(c for _, c, _ in _edits(letter, state, least[-1])) for state in range(4)]))
    least.reverse()
    at, state, audit = 0, 0, []
    while at < len(signature) or least[at][state]:
        choices = [("I", INSERT + least[at][_AFTER_INSERT[state]], _AFTER_INSERT[state])]
        if at < len(signature):
            choices += _edits(signature[at], state, least[at + 1])
        edit, _, state = min(c for c in choices if c[1] == least[at][state])
        audit.append(edit)
        at += edit != "I"
    return least[0][0], "".join(audit)


def _solved(conversations: DataFrame) -> DataFrame:
    """``conversations`` (staged) with cost and audit, from one solution of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "times", "cost", "audit"])

    counted = conversations.groupBy("signature").agg(F.count(F.lit(1)).alias("times"))
    solved = staged(counted.mapInArrow(run, "signature string, times long, cost long, audit string"), "repair-signatures")
    often = solved.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0] / HEAVY
    heavy, light = (solved.filter(c).drop("times") for c in (F.col("times") > often, F.col("times") <= often))
    by_heavy = conversations.join(F.broadcast(heavy), "signature", "left")
    by_light = by_heavy.filter("audit is null").drop("cost", "audit").join(light.hint("merge"), "signature")
    return by_heavy.filter("audit is not null").unionByName(by_light)


def _initial(role: str | None) -> str:
    return role[:1] if role else ""


def _replayed(audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, one after another."""
    turns, state = iter(turns), 0
    for edit in audit:
        if edit == "I":
            role, text = ("assistant" if state == 2 else "user"), ""
        else:
            role, text = next(turns)
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[_initial(role)]
        yield edit, role, text


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """(header, its turns) of each conversation of a stream of rows, whose header comes first; turns are read as they are needed."""
    columns = None

    def cells() -> Iterator[tuple]:
        nonlocal columns
        for batch in batches:
            columns = batch.schema.names
            for part in range(0, batch.num_rows, 512):
                yield from zip(*(c.to_pylist() for c in batch.slice(part, 512).columns), strict=True)

    rows = cells()
    row = next(rows, None)
    while row is not None:
        header = dict(zip(columns, row, strict=True))

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal row
            while (row := next(rows, None)) is not None and row[1] is None:
                yield row[2], row[3]

        own = turns()
        yield header, own
        for _ in own:
            pass


def _with_headers(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Turns behind their conversation's audit, by conversation: (conv_id, audit, role, text, cost, statistics)."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("audit"), F.asc_nulls_first("turn"), "tie", "copy"]
    turns = rows.filter(~F.col("absent")).select("conv_id", "turn", "tie", "copy", "role", "text")
    both = turns.unionByName(solved.select("conv_id", "audit", "cost", *_STATS), allowMissingColumns=True)
    # an audit is there for the header alone, and sorts before the turns, which have none
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text", "cost", *_STATS)


def plan_repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classified turns, conversations with statistics, cost and audit) of (conv_id, turn, role, text, copy, absent)."""
    rows = classified(turns)
    conversations = staged(_signatures(_codes(rows), turns.schema["conv_id"].dataType), "repair-conversations")
    return rows, _solved(conversations)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations."""
    rows, solved = plan_repairs(turns)
    columns = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, done = None, []

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                yield batch

        def out() -> pa.RecordBatch:
            cells = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cells[0], key_type), pa.array(cells[1], pa.int64()), *(pa.array(c, pa.string()) for c in cells[2:])], columns.fieldNames())

        for header, own in _streamed(typed()):
            for place, row in enumerate(_replayed(header["audit"], own)):
                done.append((header["conv_id"], place, *row))
                if len(done) == 512:
                    yield out()
                    done = []
        if done:
            yield out()

    return _with_headers(rows, solved).mapInArrow(run, columns)


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, statistics, cost, audit, repaired_sha256) of every conversation, hashed as its repaired turns stream by."""
    rows, solved = plan_repairs(turns)
    columns = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *(T.StructField(c, T.LongType()) for c in (*_STATS, "cost")), *(T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256"))])
    names = columns.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, done = None, []

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                yield batch

        def out() -> pa.RecordBatch:
            cells = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cells[0], key_type), *(pa.array(c, pa.int64()) for c in cells[1:7]), *(pa.array(c, pa.string()) for c in cells[7:])], names)

        for header, own in _streamed(typed()):
            digest = hashlib.sha256()
            for place, (_, role, text) in enumerate(_replayed(header["audit"], own)):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            done.append((*(header[c] for c in names[:-1]), digest.hexdigest()))
            if len(done) > 2000:
                yield out()
                done = []
        if done:
            yield out()

    return _with_headers(rows, solved).mapInArrow(run, columns)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the damaged table with its faults, cheapest edits and the digest of what they give."""
    return audits(damaged(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i] || [0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hurt AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, len(k) + 1), lambda j: CAST(ord(substr(k, j, 1)) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM keyed, tab),
dmg AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hurt WHERE h <> 0),
tied AS (SELECT *, sha256(CAST(len(role) AS VARCHAR) || ':' || role || text) AS tie FROM dmg),
cls AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, copy) AS i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS ini,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'k' END AS fault FROM tied),
pair AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM cls),
conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal,
    list(ini ORDER BY i) AS inis, list(fault ORDER BY i) AS faults, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM pair GROUP BY conv_id),
back AS (
  SELECT conv_id, len(inis) AS i, inis, faults, 0 AS c0, 6 AS c1, 3 AS c2, 0 AS c3, [[0, 6, 3, 0]] AS hist FROM conv
  UNION ALL
  SELECT conv_id, i - 1, inis, faults, least(r0, 3 + least(r2, 3 + r3)), least(r1, 3 + least(r2, 3 + r3)), least(r2, 3 + r3), least(r3, 3 + r2),
    [[least(r0, 3 + least(r2, 3 + r3)), least(r1, 3 + least(r2, 3 + r3)), least(r2, 3 + r3), least(r3, 3 + r2)]] || hist
  FROM (
    SELECT *, least(4 + c0, CASE WHEN gone THEN 100000 ELSE t + least(3 + c2, CASE ini WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 100000 END) END) AS r0,
      least(4 + c1, CASE WHEN gone THEN 100000 ELSE t + least(3 + c2, CASE ini WHEN 'u' THEN c2 ELSE 100000 END) END) AS r1,
      least(4 + c2, CASE WHEN gone THEN 100000 ELSE t + least(3 + c3, CASE ini WHEN 'a' THEN c3 ELSE 100000 END) END) AS r2,
      least(4 + c3, CASE WHEN gone THEN 100000 ELSE t + least(3 + c2, CASE ini WHEN 'u' THEN c2 ELSE 100000 END) END) AS r3
    FROM (SELECT *, inis[i] AS ini, faults[i] IN ('b', 'd') AS gone, CASE WHEN faults[i] = 't' THEN 3 ELSE 0 END AS t FROM back WHERE i > 0))),
walk AS (
  SELECT c.conv_id, b.hist, c.inis, c.faults, c.roles, c.texts, 0 AS i, 1 AS st, '' AS audit, CAST([] AS VARCHAR[]) AS made, b.hist[1][1] AS cost FROM conv c JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 0
  UNION ALL
  SELECT conv_id, hist, inis, faults, roles, texts, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
    CASE e WHEN 'D' THEN st WHEN 'K' THEN CASE inis[i + 1] WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE ins END, audit || e,
    CASE e WHEN 'D' THEN made WHEN 'K' THEN made || [roles[i + 1] || ':' || texts[i + 1]] WHEN 'R' THEN made || [CASE WHEN ins = 4 THEN 'assistant:' ELSE 'user:' END || texts[i + 1]]
      ELSE made || [CASE WHEN ins = 4 THEN 'assistant:' ELSE 'user:' END] END, cost
  FROM (
    SELECT *, CASE WHEN i < len(inis) AND 4 + hist[i + 2][st] = hist[i + 1][st] THEN 'D' WHEN 3 + hist[i + 1][ins] = hist[i + 1][st] THEN 'I'
      WHEN faults[i + 1] IN ('k', 't') AND t + CASE WHEN inis[i + 1] = 's' AND st = 1 THEN hist[i + 2][2] WHEN inis[i + 1] = 'u' AND st <> 3 THEN hist[i + 2][3] WHEN inis[i + 1] = 'a' AND st = 3 THEN hist[i + 2][4] ELSE 100000 END = hist[i + 1][st] THEN 'K'
      ELSE 'R' END AS e
    FROM (SELECT *, CASE WHEN st = 3 THEN 4 ELSE 3 END AS ins, CASE WHEN i < len(inis) AND faults[i + 1] = 't' THEN 3 ELSE 0 END AS t FROM walk WHERE i < len(inis) OR hist[i + 1][st] > 0))),
last AS (SELECT * FROM walk WHERE i = len(inis) AND hist[i + 1][st] = 0)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(l.cost, 0) AS BIGINT) AS cost, coalesce(l.audit, '') AS audit,
  sha256(coalesce(array_to_string(l.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN conv c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN last l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""
