"""The event sweep against a plain alignment of whole texts, and against hand-made events."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(texts):
    """(A tokens, B tokens) of each text as (id, bytes), by the plain encoders over whole texts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    for text in texts:
        if not text:
            yield [], []
            continue
        a = [(i, bytes(byte[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)]
        whole = (" " + text).encode()
        yield (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])


def spans(side):
    at = 0
    for i, raw in side:
        yield i, at, at + len(raw)
        at += len(raw)


def plain(texts):
    found = []
    for a, b in tokens(texts):
        a, b = list(spans(a)), list(spans(b))
        groups, links = [], []
        cut = sorted({e for *_, e in a} & {e for *_, e in b})
        start = 0
        for end in cut:
            groups.append([[str(i) for i, s, e in side if start <= s and e <= end] for side in (a, b)])
            start = end
        j = 0
        for x, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        found.append((len(a), len(b), groups, links))
    count = Counter(link for *_, links in found for link in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    for n_a, n_b, groups, links in found:
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        yield n_a, n_b, len(groups), len(links), sum(count[link] == best[link[1]] for link in links), sum(count[link] for link in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""


def corpus():
    rng = random.Random(8)
    words = ["the", "tion", "Über", "été", "ing", "日本", "😀", "x", "don't", "1234", "Abc", "ñandú", "...", "###", "réeux", "thelyouand"]
    line = lambda n: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))
    texts = [line(rng.randint(1, 60)) for _ in range(50)] + ["\n".join(line(6) for _ in range(9)) for _ in range(10)]
    texts += [None, "", " ", "  two  spaces ", "tail ", "tail\n", "\nhead", "a\n\nb \n c\n d", "tab\there\r\nnow", "nul\0in", "x\xa0y z　w", "a\x1cb c", "▁ no", "say ▁", "<|endoftext|> and </s> <0x41> <unk>"]
    texts += ["é combining ́", "z" * 400, "▁", "x " * 300, line(700), texts[0], texts[0], "日本語" * 50, "word​join ﻿ bom", "- ( ) -- 's 'll  's"]
    return texts


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_a_plain_one(spark, paths, monkeypatch, small):
    from fablespark.llm import alignment as A

    texts = corpus()
    docs = spark.createDataFrame([(i if i % 7 else None, t, "en", "s", i) for i, t in enumerate(texts)], SCHEMA).withColumnRenamed("lang", "row").repartition(5)
    found = A.align(docs, *paths, chunk_mb=0.01 if small else 2.0).collect()
    got = sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in found)
    assert got == sorted(plain(texts))
    want = list(plain(texts))
    for r in found:
        if r.id is not None:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[r.id][:6]


def test_short_stretches_and_a_small_cache_change_nothing(paths, monkeypatch):
    from fablespark.llm import alignment as A

    pair = A.TokenizerPair(*paths)
    texts = [" " + t for t in corpus() if t]
    whole = list(pair.encode(texts))
    monkeypatch.setattr(A, "MOST_UNITS", 10)
    for text, (a, b, good) in zip(texts, whole, strict=True):
        parts = list(pair.stretches(text, 20))
        assert "".join(parts) == text
        cut = [next(pair.encode([p])) for p in parts]
        assert good == all(g for *_, g in cut)
        if good:
            assert np.array_equal(np.concatenate([x for x, *_ in cut]), a) and np.array_equal(np.concatenate([x for _, x, _ in cut]), b)


def test_sweep_carries_what_is_open():
    from fablespark.llm.alignment import Sweep, groups_text, links_of

    sizes = np.array([1, 2, 3, 4]), np.array([1, 2, 3, 5])
    a, b = np.array([3, 0, 2, 1, 1, 0, 3], np.uint16), np.array([2, 1, 0, 1, 3, 3, 0][:6], np.uint16)
    whole = Sweep(sizes)
    whole.put(0, a)
    whole.put(1, b)
    done = whole.closed()
    assert done is not None
    n, text = groups_text(*done)
    links = links_of(*done).tolist()
    for at in range(1, len(a)):
        for to in range(1, len(b)):
            s, texts, found, groups = Sweep(sizes), b"", [], 0
            for x, y in ((a[:at], b[:to]), (a[at:], b[to:])):
                s.put(0, x)
                s.put(1, y)
                if got := s.closed():
                    k, t = groups_text(*got)
                    groups, texts = groups + k, texts + t
                    found += links_of(*got).tolist()
            assert (groups, texts, found) == (n, text, links)


def test_pair_counts_and_empty_tables(spark, paths):
    from fablespark.llm import alignment as A

    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.a, r.b): (r["count"], r.best) for r in A.linked_ids(docs, *paths).collect()}
    count = Counter()
    for a, b in tokens(texts):
        for x, s, e in spans(a):
            count.update((x, y) for y, p, q in spans(b) if p < e and s < q)
    assert {k: n for k, (n, _) in got.items()} == count
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    assert all(best == (n == top[y]) for (_, y), (n, best) in got.items())
    assert A.align(docs.limit(0), *paths).count() == 0


def test_events_are_dealt_once(spark, paths):
    from fablespark.llm import alignment as A

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = A.align(docs, *paths)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1 or plan.count("Scan parquet") == 2  # adaptive execution reuses the exchange of events at run time
