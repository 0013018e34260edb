"""Each operator against a brute-force version, on a small corpus with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus():
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(400)] + ["été", "ñandú", "Über", "日本", "😀x"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, other = line(70), line(45)
    texts = [line(rng.randint(5, 120)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " tail", "pre " + texts[1]]  # copies and near copies
    texts += [line(30) + " " + shared + " " + line(20), shared, line(10) + "\n" + shared + "\t" + line(9), other + " " + line(3) + " " + other]
    texts += [None, "", "   \n\t", "one", "a b c d", "a b c d", "z" * 300, "ab" * 200, "x " * 200, line(3000), "A B C D E", "a b c d e", "no break space"]
    near = line(100).split()
    for k in range(6):
        own = list(near)
        own[10 * k + 3] = f"edit{k}"
        texts.append(" ".join(own))
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], ["s1", "s2", "hot", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- 1 ----


def test_base_counts(docs):
    from fablespark.llm.quality_mcd import base_failed, with_statistics

    got = by_id(with_statistics(docs).withColumn("bad", base_failed()))
    for i, text, *_ in ROWS:
        w, t = words(text), text or ""
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.q_n_dup_lines, r.q_n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.bad == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_mcd_rejects_symbols_and_keeps_prose(spark):
    from fablespark.llm.quality_mcd import fit, judge, with_statistics

    rng = random.Random(3)
    vocab = ["word%d" % i for i in range(900)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(40, 400))), "en", "s1" if i % 3 else None, 0) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(vocab) + "###" for _ in range(100)), "en", "s1", 0) for i in range(12)]
    stats = with_statistics(spark.createDataFrame(rows, SCHEMA))
    one = by_id(judge(stats, fit(stats)))
    assert all(r.q_kept == (i < 1000) for i, r in one.items())
    again = by_id(judge(stats.repartition(7), fit(stats.repartition(5))))
    assert {i: r.q_distance for i, r in one.items()} == {i: r.q_distance for i, r in again.items()}


def plain_mcd(y, sizes, h=0.75, trials=40):
    """FAST-MCD from random starts, on single distances: (centre, scatter) of the smallest determinant."""
    from fablespark.llm import quality_mcd as Q

    rng = np.random.default_rng(5)
    _, distinct = np.unique(y, axis=0, return_index=True)
    y, sizes = y[distinct], sizes[distinct]
    n, want = len(y), math.ceil(h * len(y))
    factor = h / Q._chi2_cdf(Q.chi2_quantile(h), Q.P + 2)
    best = None
    for _ in range(trials):
        subset = rng.choice(n, 12, replace=False)
        last = math.inf
        for _ in range(40):
            own = y[subset]
            cov = np.cov(own.T, bias=True) * factor
            cov += np.diag(np.maximum(Q.chance(*sizes[subset].mean(0)) - np.diag(cov), 0))
            det = np.linalg.slogdet(cov)[1]
            if abs(det - last) < 1e-10:
                break
            last = det
            d = y - own.mean(0)
            subset = np.argsort(np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d), kind="stable")[:want]
        if best is None or det < best[0]:
            best = (det, own.mean(0), cov)
    return best[1:]


def test_mcd_verdict_matches_plain_fast_mcd(spark):
    """Estimates and verdicts against random starts and exact subsets: constant statistics, a second population, copies."""
    from fablespark.llm import quality_mcd as Q

    rng = np.random.default_rng(1)
    n, bad = 600, 120
    length = rng.normal(5.5, 0.9, n)
    x = np.c_[4 * np.log(np.log(np.exp(length) + math.e)), rng.normal(1.6, 0.05, n) + 0.02 * (length - 5.5), np.zeros(n), np.abs(rng.normal(0, 0.2, n)) * (rng.random(n) < 0.1), np.zeros(n)]
    x[:bad] += np.c_[np.zeros(bad), rng.normal(0.5, 0.02, bad), rng.uniform(0.2, 0.6, bad), np.zeros((bad, 2))]
    x = np.rint(x * Q.ONE).astype(int)
    x = np.r_[x, np.repeat(x[200:201], 900, axis=0)]  # copies
    sizes = np.c_[np.maximum(np.rint(np.exp(np.r_[length, np.repeat(length[200:201], 900)])), 20), np.full(len(x), 1500), np.full(len(x), 9)].astype(int)
    rows = [(int(i), *map(int, r), int(w), int(c), 0, 0, 0, int(m), "en", "s") for i, (r, (w, c, m)) in enumerate(zip(x, sizes, strict=True))]
    names = ["doc_id"] + [f"q_x{i}" for i in range(5)] + ["q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "q_n_lines"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in names), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
    stats = spark.createDataFrame(rows, schema).repartition(4)
    params = Q.fit(stats)
    got = {r.grp: r for r in params.collect()}['["en","s"]']
    center, cov = plain_mcd(x / Q.ONE, sizes)
    own = np.array(got.cov).reshape(5, 5)
    assert np.linalg.slogdet(own)[1] <= np.linalg.slogdet(cov)[1] + 0.02
    assert np.allclose(got.center, center, atol=0.02) and np.allclose(np.sqrt(np.diag(own)), np.sqrt(np.diag(cov)), rtol=0.03)
    assert np.linalg.cond(own) < 1e8 and 0.03 < math.sqrt(own[1, 1]) < 0.08  # estimated, not a constant
    d = x / Q.ONE - center
    d2 = np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)
    cut = Q.chi2_quantile(1 - 1e-6)
    clear = np.abs(d2 / cut - 1) > 0.1
    kept = by_id(Q.judge(stats, params))
    assert clear.mean() > 0.97 and all(kept[i].q_kept == (d2[i] <= cut) for i in np.flatnonzero(clear))
    assert not any(kept[i].q_kept for i in range(bad)) and np.mean([kept[i].q_kept for i in range(bad, n)]) > 0.97


def test_small_groups_have_estimates_of_their_own(spark):
    """Pooled estimates of small groups, recomputed in plain Python from their language's."""
    from fablespark.llm import quality_mcd as Q

    rng = random.Random(9)
    vocab = ["word%d" % i for i in range(900)]
    many = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(40, 400))), "en", f"s{i % 2}", 0) for i in range(300)]
    few = [(1000 + i, " ".join(rng.choice(vocab) + "x" * 4 for _ in range(rng.randint(40, 400))), "en", "small", 0) for i in range(12)]
    other = [(2000 + i, " ".join(rng.choice(vocab) for _ in range(60 + i)), "de", None, 0) for i in range(5)]
    stats = Q.with_statistics(spark.createDataFrame(many + few + other, SCHEMA))
    got = {r.grp: r for r in Q.fit(stats).collect()}
    assert set(got) == {"[]", '["en"]', '["de"]', '["en","s0"]', '["en","s1"]', '["en","small"]', '["de",null]'}
    again = {r.grp: r for r in Q.fit(stats.repartition(7)).collect()}
    assert all(np.allclose(got[g].cov, again[g].cov, rtol=1e-9) for g in got)
    parent, own = got['["en"]'], got['["en","small"]']
    cov, center = np.array(parent.cov).reshape(5, 5), np.array(parent.center)
    x = np.array([[r[f"q_x{i}"] for i in range(5)] for r in stats.filter("source = 'small'").collect()]) / Q.ONE
    d = x - center
    x = x[np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) <= 12.8325]  # the 0.975 quantile of chi-square with 5 degrees
    n, m = len(x), 50
    both = (n * np.cov(x.T, bias=True) + m * cov) / (n + m) + np.outer(x.mean(0) - center, x.mean(0) - center) * n * m / (n + m) ** 2 if n else cov
    assert np.allclose(own.center, (x.sum(0) + m * center) / (n + m) if n else center)
    assert np.allclose(np.array(own.cov).reshape(5, 5), both, atol=3e-3) and own.n == 12


# ---- 2 ----


def test_pii_base_spans_match_the_patterns():
    from fablespark.llm.pii import _base, luhn, mod97

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in s.split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)

    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "x-y.z", " ", "4111 1111 1111 1111", "1.2.3.4", "999.1.1.1", "+1 (555) 010-2345", "+", "12", "-", "é", "\n", "a%b+c", "00000255.1.1.1"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if good(k, m[0])]
        assert want == list(_base(text)), text
    assert mod97("GB82 WEST 1234 5698 7654 32") and not mod97("GB82 WEST 1234 5698 7654 33")


def test_pii_method_adds_and_redacts(spark, docs, empty):
    from fablespark.llm.pii import find_pii, redact

    text = "IBAN GB82 WEST 1234 5698 7654 32, mail a.b@c.org; call 0123 456 7890 now 4111-1111-1111-1111"
    rows = find_pii(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    got = by_id(redact(rows))
    assert [s.kind for s in got[1].pii_spans] == ["email", "card", "iban", "tel"]
    assert got[1].text == "IBAN [iban], mail [email]; call [tel] now [card]"
    assert got[2].pii_spans == [] and got[2].text is None and got[3].pii_spans == []
    assert find_pii(empty).count() == 0 and find_pii(docs).count() == len(ROWS)
    with pytest.raises(ValueError):
        find_pii(docs.withColumnRenamed("lang", "pii_spans"))


def test_pii_added_kinds_and_context():
    """Every added kind: found, kept or dropped by its context, and by its checksum."""
    from fablespark.llm.pii import iban_end, national_id, spans_of

    kinds = lambda text: [(s["kind"], text[s["start"] : s["end"]]) for s in spans_of(text) if s["kind"] not in ("email", "ip", "card", "phone")]
    long = "Ab3" * 80
    for token in (long[:180], long, long * 40):
        assert kinds(f"the token {token} here") == [("secret", token)]
        assert kinds(f"the word {token} here") == [] and kinds(f"the token sha256 {token} here") == []
    for after in (" EUR", " please", ".", " EUR 50 ONLY", "\nBIC X"):
        assert kinds("pay to BE68 5390 0754 7034" + after) == [("iban", "BE68 5390 0754 7034")], after
    assert kinds("no BE68 5390 0754 7035 EUR") == [] and kinds("serial BE68 5390 0754 7034") == []
    assert kinds("serial bank BE68 5390 0754 7034") == [("iban", "BE68 5390 0754 7034")]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32")[0] == ("iban", "DE89 3704 0044 0532 0130 00")
    assert [x for _, x in kinds("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32")] == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert iban_end("ZZ" + "0" * 20) == 0 and iban_end("BE68539007547034EUR") == 16 and kinds("BE68539007547034EUR") == []
    assert national_id("12345678Z") and not national_id("12345678A") and national_id("X1234567L")
    assert kinds("id 12345678Z of") == [("national", "12345678Z")] and kinds("order 12345678Z of") == [] and kinds("order dni 12345678Z") == [("national", "12345678Z")]
    assert kinds("Steuer-ID 86095742719 ok") == [("national", "86095742719")] and kinds("Steuer-ID 86095742718 ok") == []
    assert kinds("insee 1 84 12 76 451 089 46 x") == [("national", "1 84 12 76 451 089 46")]
    assert kinds("ssn 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("call 0123 456 7890 now") == [("tel", "0123 456 7890")] and kinds("see 0123 456 7890 now") == []
    token = "Ab3" * 8
    for pad in range(60):  # a word counts when all of it is within 40 characters, never as a part of another
        fill = " " + "." * pad + " "
        assert bool(kinds(f"x key{fill}{token}")) == (len(fill) + 3 <= 40), pad
        assert kinds(f"x monkey{fill}{token}") == [], pad
        assert bool(kinds(f"{token}{fill}key x")) == (len(fill) + 3 <= 40), pad
        assert kinds(f"{token}{fill}keyring x") == [] and kinds(f"{token}{fill}key-ring x") == [], pad


# ---- 3 ----


def test_coder_round_trips():
    from fablespark.llm.token_coder import decode_blocks, encode_blocks

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 700):
        for ids in (rng.integers(0, 65536, n), rng.zipf(1.4, n).clip(0, 60000), np.zeros(n, int), np.tile([1, 2, 3, 65535], n)[:n]):
            ids = ids.astype(np.uint32)
            shares, coded = encode_blocks(ids, 64)
            assert np.array_equal(decode_blocks(shares, coded, len(ids) - 64 * (len(coded) - 1), 64), ids)
    few = rng.integers(0, 7, 9000) * 30_011 % 2**20  # ids above 16 bits, and a table of pairs too large to count in place
    for ids in (few, np.r_[np.arange(5000), few]):
        shares, coded = encode_blocks(ids, 500)
        assert np.array_equal(decode_blocks(shares, coded, len(ids) - 500 * (len(coded) - 1), 500), ids)
    repeated = np.tile(rng.integers(0, 50000, 20), 50).astype(np.uint32)
    shares, coded = encode_blocks(repeated, 1000)
    assert len(shares) + sum(map(len, coded)) < 0.25 * 2 * len(repeated)
    with pytest.raises(ValueError):
        encode_blocks(np.arange(1 << 17))


def test_coder_beats_order_0_and_zlib(spark):
    """Prose takes less than the entropy of its ids, and than zlib needs, with all that is stored."""
    import public_tokenizers

    from fablespark.llm.token_coder import BLOCK, CachedTokenizer, decode_blocks, encode_blocks

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))(texts, 2)[0]
    shares, coded = encode_blocks(ids)
    bits = 8 * (len(shares) + sum(map(len, coded))) / len(ids)
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert bits < 0.85 * -(p * np.log2(p)).sum()
    assert bits < 0.85 * 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)
    assert np.array_equal(decode_blocks(shares, coded, len(ids) - BLOCK * (len(coded) - 1)), ids)


def test_token_files(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from fablespark.llm.token_coder import CachedTokenizer, read_tokens, write_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    write_tokens(docs, f"file://{tmp_path}/t", path, block=128, segment=2000, part_mb=0.01)
    got = by_id(read_tokens(spark, f"file://{tmp_path}/t", with_ids=True))
    plain = Tokenizer.from_file(path)
    start = 0
    for i, text, *_ in sorted(ROWS, key=lambda r: r[0]):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    write_tokens(empty, f"file://{tmp_path}/e", path)
    assert read_tokens(spark, f"file://{tmp_path}/e").count() == 0
    # null and repeated ids fill several parts, and every row keeps a place of its own
    same = spark.createDataFrame([(None if i % 2 else 7, f"text {i % 40}", "x") for i in range(400)], "doc_id long, text string, tie string").repartition(8)
    write_tokens(same, f"file://{tmp_path}/s", path, block=64, part_mb=0.0005)
    rows = read_tokens(spark, f"file://{tmp_path}/s").orderBy("start").collect()
    assert len(rows) == 400 and [r.doc_id is None for r in rows] == [True] * 200 + [False] * 200
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert spark.read.parquet(f"file://{tmp_path}/s").select("part").distinct().count() > 4
    cached = CachedTokenizer(path, most=3)
    odd = [" lead", "trail ", "two  gaps", "line\n\nline", "it's we'll", "a\tb", "nb sp", "\x1cq", "x \n y", "", None, "日本 語", "a 's b", "don 't", "a\u3000b   c\n", "  ", "\n", "a \0b", "é  è\té ", "a\x85b \x85c", " \t x"]
    for text in odd * 2:
        ids, n = cached([text], 2)
        assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2] and n.tolist() == [len(ids)], text


def test_added_tokens_in_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from fablespark.llm.token_coder import CachedTokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, cached = Tokenizer.from_file(path), CachedTokenizer(path)
    texts = ["end <|endoftext|> start", "end<|endoftext|>", "<|endoftext|>", "plain end", "<|endof text|>"]
    ids, n = cached(texts, 2)
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want] and 50256 in want[0]


def test_prose_is_coded_by_phrases(spark, tmp_path):
    """The steps of coding and decoding follow the words rather than their ids, and what is read back is the plain encoding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from fablespark.llm.token_coder import read_tokens, write_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    write_tokens(docs, f"file://{tmp_path}/t", path)
    rows = spark.read.parquet(f"file://{tmp_path}/t").collect()
    assert sum(r["block"] * (len(r["blocks"]) - 1) + r["last"] for r in rows) < 0.65 * sum(sum(r["n_ids"]) for r in rows)
    plain = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in read_tokens(spark, f"file://{tmp_path}/t").collect()}
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[r.doc_id] == (len(ids), zlib.crc32(ids.tobytes()))


def test_units_and_parts_have_the_ids_of_whole_texts():
    """Random texts of spaces, marks, contractions and added tokens; parts are kept and forgotten between calls."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from fablespark.llm.token_coder import CachedTokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(5)
    signs = [*"ab Z'.,!\n\n  \t\r0 9é’-_slltdm", "\u3000", "日", "\x1f", "\x85", "<|endoftext|>", "'ll", "'s"]
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 40, 4000)]
    for most in (3, 300, 10**6):
        cached = CachedTokenizer(path, most)
        assert [len(a) for a in cached([], 2)] == [0, 0]
        for k in range(0, len(texts), 500):
            ids, n = cached([None, *texts[k : k + 500]], 2)
            want = [[2], *([*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts[k : k + 500])]
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_phrases_round_trip(monkeypatch):
    from fablespark.llm import token_coder as tc

    rng = np.random.default_rng(6)
    size = rng.integers(1, 9, 500)
    size[:3] = 300  # longer than a phrase may be
    off, pool = np.r_[0, np.cumsum(size)], rng.integers(0, 90, size.sum()).astype(np.uint32)
    for n in (1, 5, 4000):
        for most in (1 << 16, 10):
            monkeypatch.setattr(tc, "PHRASES", most)
            unit = rng.zipf(1.3, n).clip(1, 500) - 1
            ids = np.concatenate([pool[off[u] : off[u + 1]] for u in unit])
            x, sizes, of = tc.phrased(unit, off, pool)
            assert (sizes > 1).sum() <= most
            shares, coded = tc.encode_symbols(x, sizes, of, 64)
            got, of_block = tc.decode_symbols(shares, coded, len(x) - 64 * (len(coded) - 1), 64)
            assert np.array_equal(got, ids) and of_block.sum() == len(ids) and len(of_block) == len(coded)


def test_carry_runs_through_what_is_out():
    from fablespark.llm.token_coder import Encoder

    coder = Encoder(2, 8)
    coder.out[8:11] = 5, 2**32 - 1, 2**32 - 1
    coder.at[1], coder.low[1] = 11, 2**64 - 1
    coder.put(2, np.array([0, 1 << 29]), np.array([1 << 29, 1 << 28]))
    assert coder.out[8:11].tolist() == [6, 0, 0] and not coder.out[:7].any()


def test_damaged_block_is_found(spark, docs, tmp_path):
    import public_tokenizers

    from fablespark.llm.token_coder import read_tokens, write_tokens

    write_tokens(docs, f"file://{tmp_path}/t", public_tokenizers.path("byte_bpe_50k.json"))
    files = spark.read.parquet(f"file://{tmp_path}/t")
    files.withColumn("sums", F.transform("sums", lambda s: s + 1)).write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="Damaged"):
        read_tokens(spark, f"file://{tmp_path}/bad").collect()


# ---- 4 ----


def brute_windows(rows, k):
    first, gone = {}, defaultdict(set)
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for p in range(len(w) - k + 1):
            if first.setdefault(tuple(w[p : p + k]), (i, p)) != (i, p):
                gone[i] |= set(range(p, p + k))
    return gone


@pytest.mark.parametrize("period", [3, 7, 13])
def test_substring_cover(docs, empty, period):
    from fablespark.llm.substring_cover import find_repeats

    got, gone = by_id(find_repeats(docs, period=period), "id"), brute_windows(ROWS, 20)
    for i, text, *_ in ROWS:
        w = words(text)
        assert got[i].n_words == len(w)
        assert got[i].kept_text == " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert sum(r["to"] - r["from"] for r in got[i].removed) == len(gone[i])
    if period == 7:
        assert find_repeats(empty).count() == 0


def test_covers_cover_every_difference():
    from fablespark.llm.substring_cover import COVERS

    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeated_rows_and_null_ids(spark):
    from fablespark.llm import substring_cover, suffix_dedup

    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(1)).withColumn("chunk", F.lit(2))
    got = sorted((r.id is None, r.id or 0, r.n_words, len(r.removed)) for r in substring_cover.find_repeats(d).collect())
    assert got == [(False, 5, 40, 0), (False, 5, 40, 1), (False, 9, 0, 0), (True, 0, 40, 1)]
    got = sorted((r.id is None, r.id or 0, len(r.removed)) for r in suffix_dedup.find_repeats(d).collect())
    assert got == [(False, 5, 0), (False, 5, 0), (False, 9, 0), (True, 0, 1)]


# ---- 5 ----


def test_targets_are_water_filled():
    from fablespark.llm.mixing import source_targets

    got = source_targets([("b", 100), (None, 1000), ("a", 10), ("c", 0), ("é", 50)])
    assert [g[0] for g in got] == ["a", "b", "c", "é", None]
    assert abs(sum(g[2] for g in got) - 1160) < 1e-9 and all(t <= 3 * n + 1e-9 for _, n, t in got)
    assert got[0][2] == 30 and got[2][2] == 0 and got[3][2] == 150
    free = [(g, w) for g, w in zip(got, (5, 2, 1, 5, 2), strict=True) if g[2] < 3 * g[1]]
    assert len({round(g[2] / w, 6) for g, w in free}) == 1
    assert source_targets([]) == [] and source_targets([("a", 0)]) == [("a", 0, 0.0)]


def test_permutation_is_one(spark):
    from fablespark.llm.mixing import permuted

    for n in (1, 2, 7, 100, 257):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(42).cast("long"))).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_mix(spark, docs, empty):
    from fablespark.llm.mixing import mix, n_words

    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    assert {r.doc_id: r["size"] for r in sized.collect()} == {i: len(words(t)) for i, t, *_ in ROWS}

    def taken(df):
        planned, pieces, slots = mix(df, block_words=4, shard_slots=100)
        got = {(r["__src"], r["__first"]): r.n for r in pieces.groupBy("__src", "__first").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("n")).collect()}
        return {r.doc_id: (r["size"], r.target, r["__src"], got.get((r["__src"], r["__first"]), 0) if r["size"] else 0) for r in planned.collect()}, slots

    one, slots = taken(sized)
    assert one == taken(sized.repartition(5))[0]
    assert set(one) == {r[0] for r in ROWS} and all(k <= 3 * n for n, _, _, k in one.values())
    for src in {v[2] for v in one.values()}:
        own = [v for v in one.values() if v[2] == src]
        assert abs(sum(v[3] for v in own) / own[0][1] - 1) < 0.15
    every = slots.collect()
    assert len({(r.src, r.slot) for r in every}) == len(every)
    assert Counter((r.src, r.block) for r in every).most_common(1)[0][1] <= 3
    assert taken(empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("tie")))[0] == {}


def test_taken_words_are_those_of_the_slots(spark, docs, tmp_path):
    """The query's counts from the slots and the offsets by plain loops, with null and repeated ids; reruns agree."""
    from fablespark.llm.mixing import mix, n_words, op5_mixing

    rng = random.Random(31)
    more = [(rng.choice([None, 4, 4, 7]), " ".join(["w"] * rng.randint(0, 400)), "en", rng.choice(["s1", None]), 0) for _ in range(80)]
    every = docs.unionByName(spark.createDataFrame(more, SCHEMA)).unionByName(docs.limit(5))
    every.write.parquet(f"{tmp_path}/documents.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = lambda rows: sorted(tuple((x is None, x) for x in r) for r in rows)
    got = order(op5_mixing(spark, str(tmp_path)).collect())
    sized = own.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    planned, _, slots = mix(sized.repartition(7))
    rows = planned.collect()
    times = Counter((r.src, r.block) for r in slots.collect())
    want = []
    for src in {r["__src"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["__src"] == src and r["size"]), key=lambda r: r["__first"]):
            assert r["__first"] == at
            want.append((r.doc_id, r["size"], r.source_size, r.target, sum(times[src, w // 64] for w in range(at, at + r["size"]))))
            at += r["size"]
    want += [(r.doc_id, 0, r.source_size, r.target, 0) for r in rows if not r["size"]]
    assert got == order(want)


def test_mixing_stage_gives_taken_words(spark, docs):
    from fablespark.llm.mixing import pipeline_mixing

    twice = docs.limit(20).unionByName(docs.limit(20)).withColumn("row", F.lit("clash")).withColumn("size", F.lit("x"))
    out = pipeline_mixing(spark, twice, "")
    assert out.columns == twice.columns
    original = {i: words(t) for i, t, *_ in ROWS}
    for r in out.collect():
        rest = iter(original[r.doc_id])
        assert words(r.text) and all(w in rest for w in words(r.text)) and r.n_chars == len(r.text)


# ---- 6 ----


def shingles(text, k=5):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, empty, percent):
    from fablespark.llm.setsketch import near_duplicates

    got = by_id(near_duplicates(docs, percent), "id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(ROWS, percent)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    if percent == 85:
        assert near_duplicates(empty).count() == 0


def test_family_at_the_threshold(spark):
    """Copies of one text with one to four edits: pairs on both sides of the threshold."""
    from fablespark.llm.setsketch import near_duplicates

    rng = random.Random(11)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.sample(range(140), rng.randint(1, 4)):
            w[p] = f"e{i}_{p}" if rng.random() < 0.7 else f"common{p}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = by_id(near_duplicates(spark.createDataFrame(rows, SCHEMA)), "id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(rows, 85)


def test_null_ids_in_near_dedup(spark):
    from fablespark.llm.setsketch import near_duplicates, pipeline_near_dedup

    text, other = " ".join(f"n{i}" for i in range(60)), " ".join(f"o{i}" for i in range(60))
    d = spark.createDataFrame([(5, text, "en", "s", 0), (None, text, "en", "s", 0), (None, other, "en", "s", 0), (None, None, None, None, None)], SCHEMA).withColumn("node", F.lit("clash"))
    got = sorted((r.id or -1, r.component_id or -1, r.n_shingles, r.kept) for r in near_duplicates(d).collect())
    assert got == [(-1, -1, 0, True), (-1, -1, 56, True), (-1, 5, 56, False), (5, 5, 56, True)]
    assert sorted(r.text or "" for r in pipeline_near_dedup(spark, d, "").collect()) == sorted(["", other, text])


def test_repeated_ids_with_different_texts(spark):
    """An id is one node with the links of all its texts; the stage judges its texts apart."""
    from fablespark.llm.setsketch import near_duplicates, pipeline_near_dedup

    rng = random.Random(13)
    text = lambda tag, edits=(): " ".join(f"e{tag}{i}" if i in edits else f"{tag}{i}" for i in range(120))
    rows = [(1, text("x")), (1, text("y")), (2, text("x", [50])), (3, text("y", [7])), (4, text("z")), (4, text("z")), (9, ""), (9, text("z"))]
    rows += [(None, text("z", [9])), (None, text("u")), (None, text("u")), (7, text("u", [1, 30])), (7, "A b c"), (8, "a B c"), (20, None)]
    rows += [(rng.randint(30, 50), text("w", rng.sample(range(120), rng.randint(0, 3)))) for _ in range(60)]
    d = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(5)
    got = sorted((-1 if r.id is None else r.id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in near_duplicates(d).collect())
    node = lambda i, t: (i is None, i if i is not None else t or "")
    sets, parent = [shingles(t) for _, t in rows], {node(i, t): node(i, t) for i, t in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = lambda a, b, percent: a and b and 100 * len(a & b) >= percent * len(a | b)
    for j, b in enumerate(rows):
        for i, a in enumerate(rows[:j]):
            if near(sets[i], sets[j], 85):
                x, y = root(node(*a)), root(node(*b))
                parent[max(x, y)] = min(x, y)
    want = []
    for (i, t), own in zip(rows, sets, strict=True):
        least = root(node(i, t)) if own else node(i, t)  # a row without words is linked with nothing
        want.append((-1 if i is None else i, len(own), -1 if least[0] else least[1], least == node(i, t)))
    want.sort()
    assert got == want
    assert {r[:3] for r in got if r[0] in (1, 2, 3)} == {(1, 116, 1), (2, 116, 1), (3, 116, 1)}
    # the stage: one row of each group of linked texts
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if near(sets[i], sets[j], 80):
                group[max(top(i), top(j))] = min(top(i), top(j))
    kept = [(r.doc_id, r.text, r.n_chars) for r in pipeline_near_dedup(spark, d, "").collect()]
    assert Counter(top(k) for *_, k in kept) == Counter({top(i): 1 for i in range(len(rows))})
    for i, t, k in kept:
        assert (i, t) == rows[k]
        own = [rows[m][0] for m in range(len(rows)) if top(m) == top(k)]
        assert i == min((x for x in own if x is not None), default=None)


def test_open_buckets_of_a_template(spark):
    """Many documents that share most of a template but not the threshold, with near copies among them."""
    from fablespark.llm.setsketch import near_duplicates

    rng = random.Random(17)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(240):
        w = list(base) + [f"r{i}_{j}" for j in range(rng.choice([5, 40, 60, 70]))]
        rows.append((2 * i, " ".join(w), "en", "s", 0))
        if i % 5 == 0:
            w[3] = f"edit{i}"
            rows.append((2 * i + 1, " ".join(w), "en", "s", 0))
    got = by_id(near_duplicates(spark.createDataFrame(rows, SCHEMA)), "id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(rows, 85)


def test_rows_of_a_family_below_the_threshold(spark, monkeypatch):
    """Documents that all share 240 words and differ in 30: no link at 85, and no table grows with the square of their number."""
    from fablespark.llm import setsketch as S

    counts = {}

    def counting(df, name):
        out = plain(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    plain = S.staged
    monkeypatch.setattr(S, "staged", counting)
    seen = []
    for n in (100, 200):
        counts.clear()
        rng = random.Random(5)
        shared = [f"s{rng.randrange(10**9)}" for _ in range(240)]
        rows = [(i, " ".join(shared + [f"w{rng.randrange(10**9)}" for _ in range(30)]), None, None, 0) for i in range(n)]
        got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == n and all(r.kept for r in got)
        seen.append(dict(counts))
    assert all(k <= 2.6 * seen[0].get(name, 0) + 100 for name, k in seen[1].items()), seen
    assert seen[1].get("setsketch-rest", 0) == 0


def test_any_number_may_be_an_id(spark):
    from fablespark.llm.setsketch import near_duplicates

    text = " ".join(f"w{i}" for i in range(80))
    ids = [2**62, 2**62 + 5, 2**63 - 1, -3, -(2**63), None, 7]
    rows = [(i, f"{text} own{k}" if k % 2 else f"other {text[200:]} {k}", None, None, 0) for k, i in enumerate(ids)]
    want = brute_near(rows, 85)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(ids)
    for group in want:
        least = min((i for i in group if i is not None), default=None)
        assert all(got[i][1:] == (least, i == least) for i in group)


def brute_near(rows, percent):
    """Groups of ids whose texts are linked, each pair compared on full sets."""
    sets = []
    for i, text, *_ in rows:
        w = text.lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    groups = [{i} for i, _ in sets]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if 100 * len(a & b) >= percent * len(a | b):
                one, two = (next(g for g in groups if k in g) for k in (i, j))
                if one is not two:
                    groups.remove(two)
                    one |= two
    return groups


def test_joint_estimate_is_close():
    from fablespark.llm.setsketch import joint_similarity, registers

    rng = np.random.default_rng(4)
    both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    r = [registers(np.r_[both, x], np.array([0, 900])) for x in (one, two)]
    assert abs(joint_similarity(*r, np.array([900.0]), np.array([900.0]))[0] - 0.8) < 0.15


def test_components_of_a_chain(spark):
    from fablespark.llm.components import components

    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ---- 7 ----


def test_decontamination(spark, docs, empty):
    from fablespark.llm.decontaminate import fit, lcs_length, with_matches

    rng = random.Random(9)
    vocab = ["q%d" % i for i in range(3000)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(15, 50))] for _ in range(30)]
    bench = spark.createDataFrame([(k, " ".join(w) + ".") for k, w in enumerate(items)] + [(98, None), (99, " ")], "item_id long, text string")
    filler = lambda n: [f"f{rng.randint(0, 500)}" for _ in range(n)]
    rows, want = [], set()
    for k, w in enumerate(items):
        kind = k % 3
        body = list(w)
        if kind == 1:
            for p in rng.sample(range(len(w)), len(w) // 5):
                body[p] = "other"
        if kind == 2:
            body = rng.sample(w, len(w) // 3)
        if kind < 2:
            want.add((k, k))
        rows.append((k, " ".join(filler(rng.randint(0, 300)) + body + filler(50)), "en", "s", 0))
    rows += [(500 + i, " ".join(filler(200)), "en", "s", 0) for i in range(20)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = with_matches(d, fit(d, bench)).collect()
    assert len(got) == len(rows) and {(r.doc_id, m.item_id) for r in got for m in r.benchmark_matches} == want
    assert with_matches(empty, fit(empty, bench)).count() == 0
    assert fit(d, bench.limit(0)) is None and with_matches(d, None).filter(F.size("benchmark_matches") > 0).count() == 0

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = [[rng.randint(0, 5) for _ in range(rng.randint(1, 20))] for _ in range(2)]
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert lcs_length(masks, len(a), b) == plain(a, b)


def test_short_items_and_null_ids(spark):
    """Items of few words do not match texts that merely use them."""
    from fablespark.llm.decontaminate import fit, with_matches

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "is", "it", "what", "of", "a", "sun", "far"]) for _ in range(60)) for _ in range(10)]
    texts += ["Is it", "so we ask how far is the red sun now", "how far is that red sun now", "the"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    items = spark.createDataFrame([(1, "the"), (2, "is it"), (3, "how far is the red sun"), (None, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    more = spark.createDataFrame([(99, "zero one two three four five six seven eight nine ten eleven twelve thirteen", "en", "s", 0)], SCHEMA)
    both = docs.unionByName(more)
    got = {(r.doc_id, r.m.item_id) for r in with_matches(both, fit(both, items)).select("doc_id", F.explode("benchmark_matches").alias("m")).collect()}
    assert got == {(10, 2), (11, 3), (13, 1), (99, None)}


def test_item_in_a_third_of_documents(spark):
    from fablespark.llm.decontaminate import fit, with_matches

    rng = random.Random(3)
    item = [f"q{i}" for i in range(38)]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(f"r{i}" for i in range(30)))], "item_id long, text string")
    filler = lambda n: [f"f{rng.randint(0, 900)}" for _ in range(n)]
    rows = [(k, " ".join(filler(20) + (item if k % 3 == 0 else filler(38)) + filler(20)), "en", "s", 0) for k in range(300)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = with_matches(d, fit(d, bench)).collect()
    assert {(r.doc_id, m.item_id) for r in got for m in r.benchmark_matches} == {(k, 0) for k in range(0, 300, 3)}


def test_decontamination_gate_is_lossless(spark):
    """Against every window by brute force: many items of common words, short questions, copies with edits."""
    from fablespark.llm.decontaminate import COPY, SIZE, STEP, fit, with_matches

    rng = random.Random(4)
    vocab = [f"c{i}" for i in range(120)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([2, 3, 5, 12, 25, 40]))] for _ in range(300)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    texts = []
    for k in range(0, 300, 2):
        body = [w if rng.random() > 0.15 * (k % 4 == 0) else "other" for w in items[k]]
        texts.append([f"f{rng.randint(0, 50)}" for _ in range(rng.randint(0, 60))] + body + [rng.choice(vocab) for _ in range(30)])
    rows = [(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)] + [(1000 + k, " ".join(["7", "+", "5"]), "en", "s", 0) for k in range(30)]
    bench = bench.union(spark.createDataFrame([(900, "7 + 5")], bench.schema))
    items = dict(enumerate(items)) | {900: ["7", "+", "5"]}
    d = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, m.item_id) for r in with_matches(d, fit(d, bench)).collect() for m in r.benchmark_matches}

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            up = row
            row = [0]
            for j, y in enumerate(b):
                row.append(up[j] + 1 if x == y else max(up[j + 1], row[j]))
        return row[-1]

    copies, short = set(), set()
    for doc, text, *_ in rows:
        seq = text.split()
        for i, w in items.items():
            if len(w) < 8:  # all words in a row; under five words only as the whole document
                if seq == w or len(w) >= 5 and any(seq[k : k + len(w)] == w for k in range(len(seq))):
                    short.add((doc, i))
                continue
            for lo in range(0, max(1, len(seq) - STEP), STEP):
                near = seq[max(0, lo - len(w)) : lo + SIZE + len(w)]
                if sum((Counter(near) & Counter(w)).values()) >= COPY * len(w) and common(w, near) >= COPY * len(w):
                    copies.add((doc, i))
                    break
    assert len(copies) > 60 and copies <= got
    assert len(short) > 40 and short == {(d, i) for d, i in got if len(items[i]) < 8}


def test_decontamination_of_paraphrases(spark):
    """Items with words replaced by synonyms and inserted words, against a plain version of the whole result, twice."""
    from fablespark.llm.decontaminate import ANSWER, COPY, NEAR, PART, SIZE, STEP, fit, with_matches

    rng = random.Random(12)
    vocab = [f"p{i}" for i in range(900)]
    items = {k: [rng.choice(vocab) for _ in range(rng.randint(16, 36))] for k in range(60)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    rows, wanted = [], set()
    for k, w in items.items():
        body = []
        for p, x in enumerate(w):
            body.append(f"syn{x}" if rng.random() < 0.3 and p < len(w) - 1 else x)
            if rng.random() < 0.1:
                body.append("well")
        rows.append((k, " ".join([rng.choice(vocab) for _ in range(rng.randint(5, 90))] + body + [rng.choice(vocab) for _ in range(40)]), "en", "s", 0))
        wanted.add((k, k))
    rows += [(100 + k, " ".join(rng.choice(vocab) for _ in range(150)), "en", "s", 0) for k in range(60)]
    d = spark.createDataFrame(rows, SCHEMA)

    def found(df):
        return sorted((r.doc_id, m.item_id, m.cosine, m.lcs, m.answer_lcs) for r in with_matches(df, fit(df, bench)).collect() for m in r.benchmark_matches)

    one = found(d)
    assert one == found(d.repartition(7))  # the same to the last digit, however rows are dealt

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            up, row = row, [0]
            for j, y in enumerate(b):
                row.append(up[j] + 1 if x == y else max(up[j + 1], row[j]))
        return row[-1]

    strong, weak = set(), set()  # copies, and what passes all checks but the cosine's
    for doc, text, *_ in rows:
        seq = text.split()
        for i, w in items.items():
            if len(w) < 8:  # all words in a row; under five words only as the whole document
                if seq == w or len(w) >= 5 and any(seq[k : k + len(w)] == w for k in range(len(seq))):
                    short.add((doc, i))
                continue
            for lo in range(0, max(1, len(seq) - STEP), STEP):
                near = seq[max(0, lo - len(w)) : lo + SIZE + len(w)]
                if sum((Counter(near) & Counter(w)).values()) < PART * len(w):
                    continue
                n = common(w, near)
                if n >= COPY * len(w):
                    strong.add((doc, i))
                elif n >= PART * len(w) and common(w, near) >= ANSWER * len(w):
                    weak.add((doc, i))
    got = {r[:2] for r in one}
    assert strong <= got <= strong | weak and len(wanted & (strong | weak)) > 50
    assert len(wanted & got) >= 0.9 * len(wanted & (strong | weak)) and all(c >= NEAR for *k, c, _, _ in one if tuple(k) not in strong)


# ---- 8 ----


@pytest.mark.parametrize("width", [50, 26])
def test_suffix_dedup(docs, empty, width):
    from fablespark.llm.suffix_dedup import find_repeats

    got, least = by_id(find_repeats(docs, width), "id"), {}
    raw = {i: (t or "").encode() for i, t, *_ in ROWS}
    for i in sorted(raw, reverse=True):
        for p in range(len(raw[i]) - width + 1):
            least[raw[i][p : p + width]] = i
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < i:
                gone[p : p + width] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert got[i].n_bytes == len(b) and bytes(got[i].kept) == bytes(x for x, g in zip(b, gone, strict=False) if not g)
        assert len(got[i].removed) == spans
    if width == 50:
        assert find_repeats(empty).count() == 0


def test_deep_shallow_sorts():
    from fablespark.llm.suffix_dedup import deep_shallow

    rng = random.Random(6)
    text = "".join(rng.choice("ab") * rng.choice([1, 1, 30]) for _ in range(200)).encode() + bytes(range(256)) * 2
    starts = np.arange(len(text) - 50 + 1)
    order, group = deep_shallow(np.frombuffer(text, np.uint8), starts, 50)
    sorted_ = [text[s : s + 50] for s in starts[order]]
    assert sorted_ == sorted(sorted_)
    assert [a == b for a, b in zip(sorted_, sorted_[1:], strict=False)] == (np.diff(group) == 0).tolist()


def test_hot_phrase_is_dealt_out():
    from fablespark.llm.suffix_dedup import deal, minimisers

    rng = random.Random(8)
    noise = lambda n: bytes(rng.randrange(128, 256) for _ in range(n))
    texts = [noise(40) + b"under the licence of the site, see there" + noise(40) for _ in range(400)]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    start, size, gram = minimisers(buf, off, 50)
    grams, where, n = np.unique(gram, return_inverse=True, return_counts=True)
    hot = n[where] > 64
    assert hot.any()
    first, windows, run, bucket = deal(buf.tobytes(), start, size, gram, hot, 48, 50)
    assert windows.sum() == size.sum()
    one = np.bincount(bucket[hot[run]], weights=windows[hot[run]], minlength=48)
    assert one.max() < one.sum() / 12  # all in the gram's own bucket before


def test_suffix_dedup_with_hot_grams(docs):
    from fablespark.llm.suffix_dedup import find_repeats

    rows = lambda hot: sorted((r.id, r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in find_repeats(docs, hot=hot).collect())
    assert rows(1) == rows(10**6)


# ---- 9 ----


def plain_weights(events, n, v):
    """Expectation-maximisation over single events: {context: weights of the four estimates}."""
    by_context = defaultdict(list)
    for ctx, *p in events:
        by_context[ctx].append([*p[:2], p[2] / max(n - 1, 1), 1 / (v + 1)])
    out = {}
    for ctx, p in by_context.items():
        has = [ctx >= 24, True, True, True]
        w = [a * b for a, b in zip((0.3, 0.3, 0.3, 0.1), has, strict=True)]
        w = [x / sum(w) for x in w]
        for _ in range(60):
            new = [0.0] * 4
            for q in p:
                share = [a * b for a, b in zip(q, w, strict=True)]
                new = [a + b / sum(share) for a, b in zip(new, share, strict=True)]
            w = [max(x / len(p), 1e-7 * h) for x, h in zip(new, has, strict=True)]
            w = [x / sum(w) for x in w]
        out[ctx] = w
    return out


def test_language_model(spark, empty):
    """Against single counts, with weights from expectation-maximisation over single events."""
    from fablespark.llm.interpolated_lm import score

    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(60)]
    chain = lambda n: [vocab[min(59, int(rng.expovariate(0.15)))] for _ in range(n)]
    rows = [(i, " ".join(chain(rng.randint(0, 80))), "en", "s", 0) for i in range(90)] + [(200, None, "en", "s", 0), (201, "V1 v2  v1 V2 v1 zz", "en", "s", 0)] + [r for r in ROWS[:30]]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {i: [*words((t or "").translate(low)), None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    one, two, tri = Counter(), Counter(), Counter()
    for i, w in toks.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["<s>", *w], w, strict=False))
            tri.update(zip(["<s>", *w], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    level = lambda c: min(int(math.log2(c)) + 1, 23) if c > 0 else 0

    def estimates(w, deleted):
        """(context, p3, p2, count) of each token."""
        d = int(deleted)
        for k, x in enumerate(w):
            h = w[k - 1] if k else "<s>"
            g = (w[k - 2] if k > 1 else "<s>") if k else None
            word = max((one[h] if k else one[None]) - d, 0)
            pair, last = two[h, x], two[g, h] if k else 0
            three = tri[g, h, x] if k and pair > 1 and last > 1 else 0
            last = max((last if last > 1 else 0) - d, 0)
            yield (24 + level(last) if last else level(word), max(three - d, 0) / last if last else 0, max(pair - d, 0) / word if word else 0, max(one[x] - d, 0))

    lam = plain_weights([e for i, w in toks.items() if not held[i] for e in estimates(w, True)], n, v)
    start = [[0, 3 / 7, 3 / 7, 1 / 7], [0.3, 0.3, 0.3, 0.1]]
    got = by_id(score(spark.createDataFrame(rows, SCHEMA).repartition(3)), "id")
    seen = set()
    for i, w in toks.items():
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        total = 0.0
        for ctx, p3, p2, c in estimates(w, False):
            l = lam.get(ctx, start[ctx >= 24])
            seen.add(ctx)
            total += math.log10(l[0] * p3 + l[1] * p2 + l[2] * c / n + l[3] / (v + 1))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(one[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert abs(r.score - total) < 0.02 * abs(total), (i, r.score, total)  # cells round probabilities
    assert len(seen) > 8
    assert score(empty).count() == 0


def test_learned_weights_match_plain_em():
    from fablespark.llm.interpolated_lm import learn
    import pandas as pd

    rng = random.Random(2)
    events = []
    for _ in range(400):
        ctx = rng.choice([0, 3, 26, 30])
        events.append((ctx, 2 ** -rng.randint(0, 4) if ctx >= 24 and rng.random() < 0.6 else 0, 2 ** -rng.randint(1, 8) if rng.random() < 0.8 else 0, 2 ** rng.randint(0, 9)))
    n, v = 5001, 300
    code = lambda p, k: int(-np.log2(p) * k) if p > 0 else -10000
    cells = Counter((c, code(a, 2), code(b, 2), code(d, 1)) for c, a, b, d in events)
    table = pd.DataFrame([(*k, m) for k, m in cells.items()] + [(-1, 0, 0, 0, n), (-2, 0, 0, 0, v)], columns=["ctx", "p3", "p2", "p1", "n"])
    lam = np.frombuffer(learn(table)["keys"][0])[2:].reshape(48, 4)
    for ctx, w in plain_weights(events, n, v).items():
        assert np.allclose(lam[ctx], w, atol=1e-9)
    assert np.allclose(lam.sum(1), 1)


def test_messages_follow_keys_not_buckets():
    """A chunk's messages are as many as the buckets its keys fall in, whatever the number of buckets."""
    from fablespark.llm._packed import bit_pieces, bucket_of, read_bits, split
    from fablespark.llm.substring_cover import ask_keys, merge_keys

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    for buckets in (1, 48, 2**31 - 1):
        out = ask_keys(keys, keys % np.uint64(3) == 0, 7, buckets)
        assert len(out) == len(np.unique(bucket_of(keys, buckets))) <= min(buckets, len(keys))
        size = np.diff(split(bucket_of(keys, buckets))[1])
        assert sum(len(x.as_py()) for x in out.column("keys")) == 8 * len(keys) and len(size) == len(out)
        if buckets < 100:
            multi = np.concatenate([read_bits(merge_keys(out.slice(i, 1)).column("keys"), size[i : i + 1]) for i in range(len(out))])
            assert np.array_equal(multi, keys % np.uint64(3) == 0)
    from fablespark.llm._packed import placed
    from fablespark.llm.interpolated_lm import key_pieces, read_places
    from fablespark.llm._text import column_bytes

    assert all(int(b) == int(k) * 977 >> 64 and int(p) == (int(k) * 977 >> 24) & (2**40 - 1) for k, b, p in zip(keys[:99], *(x[:99] for x in placed(keys, 977)), strict=True))
    for buckets in (1, 300, 10**6):  # differences, and places where a difference is too large
        bucket, place = placed(keys, buckets)
        _, edges = split(bucket)
        own, base = key_pieces(place, edges)
        assert np.array_equal(read_places(*column_bytes(own), np.diff(edges), base), place)
    mask, edges = rng.random(50) < 0.5, np.array([0, 3, 3, 11, 50])
    assert np.array_equal(read_bits(bit_pieces(mask, edges), np.diff(edges)), mask)


# ---- 10 ----


def test_sharding(spark, docs, empty):
    from fablespark.llm.sharding import lookup_table, slot_of, with_shard

    names = [f"n{i}" for i in range(13)]
    table = lookup_table(names, 1009)
    assert Counter(table).most_common()[0][1] - Counter(table).most_common()[-1][1] <= 1
    fewer = lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 12) < 0.3 * 1009
    # a plain version: full preference lists, turn by turn
    number = lambda name, use: int.from_bytes(hashlib.md5(f"{use}:{name}".encode()).digest()[:8], "big")
    prefs = [[(number(s, "offset") + j * (number(s, "skip") % 1008 + 1)) % 1009 for j in range(1009)] for s in names]
    plain, at = {}, [0] * 13
    while len(plain) < 1009:
        for k in range(13):
            while prefs[k][at[k]] in plain:
                at[k] += 1
            plain[prefs[k][at[k]]] = k
            if len(plain) == 1009:
                break
    assert [plain[i] for i in range(1009)] == table
    odd = spark.createDataFrame([(1, "a", "b", "c", "d")], "doc_id int, __slot string, __SHARD string, __key_slot string, slot string")
    assert with_shard(odd).columns == [*odd.columns, "shard"] and with_shard(odd).first()["__slot"] == "a"
    with pytest.raises(ValueError):
        with_shard(odd.withColumnRenamed("slot", "Shard"))
    clash = docs.withColumn("slot", F.lit("x")).unionByName(spark.createDataFrame([(None, "t", None, None, None)], SCHEMA).withColumn("slot", F.lit("y")))
    out = with_shard(clash, shards=names, slots=1009)
    assert out.columns == [*clash.columns, "shard"] and out.count() == len(ROWS) + 1
    for r in out.collect():
        digest = hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()
        assert r.shard == table[int(digest[:15], 16) % 1009]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    assert with_shard(empty).count() == 0 and slot_of(F.lit(1)) is not None
    for bad in (10, 0):
        with pytest.raises(ValueError):
            lookup_table(names, bad)


# ---- pipeline ----


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in C.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns + ["shard"] * (name == "sharding")
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Extra columns with names that stages use, in either case, null and repeated ids, pass all stages."""
    import corpus_pipeline as C

    rng = random.Random(41)
    text = lambda: " ".join(f"k{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 90)))
    rows = [(i, text(), "en", "s", 0) for i in range(30)]
    rows += [(3, text(), "en", "s", 0), (3, text(), "de", None, 0), (None, text(), "en", "s", 0), (None, rows[0][1], "en", "s", 0), rows[5], rows[5], (40, None, None, None, None), (41, "", "en", "s", 0)]
    names = ["__node", "SHARD", "__q_n_words", "__matches", "doc", "row", "chunk", "tie", "__g0", "__slot", "runs", "grp"]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    texts = {t for _, t, *_ in rows if t}
    for name, stage in C.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001").cache()
        got = docs.collect()
        assert docs.columns == before.columns + ["shard_"] * (name == "sharding"), name
        assert all(r[n] == f"own {n}" for r in got for n in names), name
        if name == "near_dedup":
            assert len(got) == len(texts) and {r.text for r in got} == texts
    assert len(got) > 25


def test_empty_pipeline(spark, empty):
    import corpus_pipeline as C

    docs = empty
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_sketch_sums_every_passage(spark):
    """The sketch is the Gram matrix of all passages times the random matrix, also of documents that hold no item."""
    import random
    from collections import Counter

    from fablespark.llm import decontaminate as X

    rng = random.Random(4)
    names = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(names[: rng.choice([3, 20, 300])]) for _ in range(rng.choice([1, 11, 24, 25, 130]))) for _ in range(150)] + ["", "other words only"]
    hashes = {n: X._hash_text(n)[0] for n in names}
    terms = np.sort(np.array([hashes[n] for n in names[:200]]))
    weight = np.linspace(1, 3, len(terms))
    place = {n: int(np.searchsorted(terms, h)) for n, h in hashes.items() if h in terms}
    omega = X.random_signs(terms, 16, 5)
    want = np.zeros((len(terms), 16))
    for text in texts:
        words = text.split()
        n = max(1, -(-(len(words) - X.STEP) // X.STEP)) if words else 0
        for k in range(n):
            own = Counter(place[w] for w in (words[k * X.STEP :] if k == n - 1 else words[k * X.STEP : k * X.STEP + X.SIZE]) if w in place)
            x = np.zeros(len(terms))
            for t, c in own.items():
                x[t] = (1 + np.log(c)) * weight[t]
            x /= max(np.linalg.norm(x), 1e-12)
            want += np.outer(x, x @ omega)
    got = X._gram_sketch(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), terms, weight, 16, 5)
    assert np.abs(got - want).max() < 0.02 * max(1.0, np.abs(want).max()) and np.abs(want).max() > 5
    few = [spark.createDataFrame([(t,) for t in texts], "text string").repartition(n) for n in (1, 5)]
    assert (X._gram_sketch(few[0], terms, weight, 16, 5) == X._gram_sketch(few[1], terms, weight, 16, 5)).all()


def test_language_model_counts_every_trigram(spark):
    """With ``least`` 1 a trigram has its estimate also where one of its pairs occurs once in training."""
    from fablespark.llm.interpolated_lm import score

    rng = random.Random(5)
    texts = [" ".join(f"v{min(199, int(rng.expovariate(0.02)))}" for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += texts[:6] + ["only once here"] + ["only once here"]
    toks = {i: [*t.split(), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    one, two, tri = Counter(), Counter(), Counter()
    for i, w in toks.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["<s>", *w], w, strict=False))
            tri.update(zip(["<s>", *w], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    level = lambda c: min(int(math.log2(c)) + 1, 23) if c > 0 else 0

    def estimates(w, d):
        for k, x in enumerate(w):
            h, g = (w[k - 1] if k else "<s>"), (w[k - 2] if k > 1 else "<s>")
            word = max((one[h] if k else one[None]) - d, 0)
            last = max((two[g, h] if k else 0) - d, 0)
            three = max((tri[g, h, x] if k else 0) - d, 0)
            yield (24 + level(last) if last else level(word), three / last if last else 0, max(two[h, x] - d, 0) / word if word else 0, max(one[x] - d, 0))

    lam = plain_weights([e for i, w in toks.items() if not held[i] for e in estimates(w, 1)], n, v)
    start = [[0, 3 / 7, 3 / 7, 1 / 7], [0.3, 0.3, 0.3, 0.1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, cut = by_id(score(df, least=1), "id"), by_id(score(df), "id")
    for i, w in toks.items():
        total = 0.0
        for ctx, p3, p2, c in estimates(w, 0):
            l = lam.get(ctx, start[ctx >= 24])
            total += math.log10(l[0] * p3 + l[1] * p2 + l[2] * c / n + l[3] / (v + 1))
        assert abs(got[i].score - total) < 0.02 * abs(total) + 0.01, (i, got[i].score, total)
    assert sum(abs(got[i].score - cut[i].score) > 0.1 * abs(got[i].score) for i in toks) > 20
    assert any(held[i] and got[i].score > cut[i].score + 0.5 for i in toks)


def test_pipeline_stages_take_small_batches(spark):
    """Whole texts reach Python in batches of a few MB, not of Spark's 64 MB; a lower setting stays."""
    import pyarrow as pa

    from fablespark.llm.decontaminate import op7_decontaminate, pipeline_decontaminate
    from fablespark.llm.quality_mcd import pipeline_quality
    from fablespark.llm.setsketch import pipeline_near_dedup

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = spark.range(0, 1500, 1, 1).selectExpr("repeat('some words ', 2000) AS text")
    largest = lambda: texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").agg({"n": "max"}).first()[0]
    try:
        for stage in (pipeline_quality, pipeline_near_dedup, pipeline_decontaminate, lambda s, _, d: op7_decontaminate(s, d)):
            spark.conf.set(key, "64m")
            stage(spark, docs, sf)
            assert largest() < 12 << 20
        spark.conf.set(key, "1m")
        pipeline_decontaminate(spark, docs, sf)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, was)


def test_group_sums():
    from fablespark.llm.decontaminate import _group_sums

    rng = np.random.default_rng(3)
    rows, at, value = rng.integers(-9, 9, (20, 5)).astype(float), rng.integers(0, 20, 200), rng.integers(1, 9, 200).astype(float)
    head = np.r_[0, np.sort(rng.choice(np.arange(1, 200), 40, replace=False))]
    assert (_group_sums(rows, at, value, head) == np.add.reduceat(rows[at] * value[:, None], head)).all()
    none = np.zeros(0, np.int64)
    assert _group_sums(rows, none, value[:0], none).shape == (0, 5)


def test_language_model_exchanges_answers_once(spark):
    """Chunks exchange their texts, the answers on pairs, and all answers; not all answers again with the model."""
    from fablespark.llm.interpolated_lm import score

    df = spark.createDataFrame([(i, f"a b c w{i % 7} d e") for i in range(60)] + [(None, None)], "doc_id long, text string")
    out = score(df, least=1)
    assert out.count() == 61
    found = score(df, least=1)
    rows = found.collect()
    assert len(rows) == 61 and all(r.score < 0 for r in rows)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = set(re.findall(r"(?<!Reused)Exchange hashpartitioning\(chunk#\d+L?[^\n]*plan_id=(\d+)", plan))
    again = re.findall(r"ReusedExchange", plan)
    assert len(made) == 3 and again, plan
