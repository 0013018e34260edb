"""Structure repair against plain versions: edits by exhaustive search, damage and faults row by row."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

SCHEMA = "conv_id long, turn long, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def searched(turns):
    """(cost, audit) by a search over (cost, audit) in order; turns are (initial, fault)."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit
        steps = [("I", 3, at, "u"), ("I", 3, at, "a")]
        if at < len(turns):
            initial, fault = turns[at]
            steps.append(("D", 4, at + 1, ""))
            if fault in ("sound", "truncated"):
                more = 3 * (fault == "truncated")
                steps += [("K", more, at + 1, initial), ("R", 3 + more, at + 1, "u"), ("R", 3 + more, at + 1, "a")]
        for edit, price, to, added in steps:
            if re.fullmatch("s?(ua)*u?", made + added):
                heapq.heappush(heap, (cost + price, audit + edit, to, made + added))
    raise AssertionError


def test_solutions_equal_an_exhaustive_search():
    from fablespark.llm.structure_repair import solve

    meaning = {"x": ("u", "blank")} | {c: (c, "sound") for c in "suao"} | {c.upper(): (c, "truncated") for c in "suao"}
    for n in range(4):
        for letters in itertools.product("suaoUAx", repeat=n):
            assert solve("".join(letters)) == searched([meaning[c] for c in letters]), letters
    rng = random.Random(2)
    for _ in range(150):
        letters = [rng.choice("suaoSUAOxua") for _ in range(rng.randint(4, 7))]
        assert solve("".join(letters)) == searched([meaning[c] for c in letters]), letters


def plain(rows):
    """Every column of the query, by conversation."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        hurt = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if hurt:
            text = "" if hurt == 1 else re.sub("[.!?]", "", text) if hurt == 2 else text
            own += [(turn, "user" if hurt == 4 else role, text)] * (2 if hurt == 3 else 1)
    out = {}
    for conv, own in by.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, turns = set(), []
        for _, role, text in own:
            ink = INK.findall(text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "sound" if ink[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role[:1] or "?", fault))
        cost, audit = searched(turns)
        made, rest = [], iter(own)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[1:]
            if edit != "D":
                if edit in "IR":
                    role = "assistant" if made and made[-1].startswith("u") else "user"
                made.append(f"{role}:{text}")
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = [sum(f == k for _, f in turns) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "why?", "cut off", "", "  \n", None, "same.", "tail. \t\n", "é…", "a" * 50000 + ".", "dot . then"]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "admin"]
    out = [(c, t, rng.choice(roles[:2] * 6 + roles), rng.choice(texts)) for c in range(60) for t in rng.sample(range(-2, 12), rng.randint(1, 6))]
    out += [(c, None, "user", "no number.") for c in (3, 3, 5)] + [(None, t, "user", "no id.") for t in (1, 2, None, None)]
    out += [(200 + c, t, ["user", "assistant"][t % 2], f"Turn {c % 3}.") for c in range(40) for t in range(4)]  # few signatures
    out += [(900, t, "user", "x.") for t in (5, 5, 5, 7)]
    rng.shuffle(out)
    return out


def test_audits_match_a_plain_version(spark, rows, monkeypatch):
    from fablespark.llm import structure_repair as S

    monkeypatch.setattr(S, "HEAVY", 20)  # so that both joins are used
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    got = {r.conv_id: tuple(r)[1:] for r in S.audits(S.damaged(table)).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == want[key], key


def test_repaired_turns(spark, rows):
    from fablespark.llm import structure_repair as S

    turns = S.damaged(spark.createDataFrame(rows, SCHEMA))
    by = {}
    for r in S.repaired(turns).collect():
        by.setdefault(r.conv_id, {})[r.place] = f"{r.role}:{r.text}"
    for r in S.audits(turns).collect():
        own = by.get(r.conv_id, {})
        assert sorted(own) == list(range(len(own)))
        assert hashlib.sha256("\n".join(own[i] for i in range(len(own))).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(own[i][0] for i in range(len(own))))


def test_one_long_conversation_and_an_empty_table(spark):
    from pyspark.sql import functions as F

    from fablespark.llm import structure_repair as S

    many = spark.range(30000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(0).alias("audit"))
    one = S.audits(S.damaged(many)).collect()
    assert len(one) == 1 and len(one[0].audit) > 28000 and set(one[0].audit) <= set("DIKR")
    assert S.audits(S.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
