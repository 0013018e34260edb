"""Robust multivariate outliers among document statistics (minimum covariance determinant).

Each document gets word and character counts, from which five transformed statistics are
formed: the log of log length, log mean word length, and the arcsine roots of its symbol share,
repeated line share and repeated window share. For every (language, source) a
minimum-covariance-determinant estimate of centre and scatter is fitted to the group's distinct
statistic vectors (copies count once): three starts (median with quartile scales, with spatial-sign
correlations, and the half nearest to the median) take two concentration steps each, and that of the
smallest determinant goes on until its determinant stays. Documents whose Mahalanobis distance
exceeds a chi-square cut are rejected.

The scatter is that of the h-subset, with the usual factor. Where statistics hardly vary in it, as
shares that are 0 in most documents, it is singular; there a deviation counts as at least what
chance gives a document of the group's mean size: an arcsine root of a share of m things has
variance 1/(4 m), with characters, lines and pairs of eight-word windows as things; mean word length has
variance 1/(4 words), as words deviate by half their length about; and log length has the
resolution of its number alone.

Scale: documents are read in Arrow batches without a shuffle. A concentration step is one
aggregation to (group, distance bin) with map-side sums, so a hot source costs nothing extra;
documents of the bin in which the h-subset ends count in part, so its size is exact. Statistics are
fixed-point integers, which makes every sum exact and reruns equal. The estimates (one row for
each group) are joined, and Spark broadcasts them only while they stay under its size threshold.

Edge cases: a null or empty text has zero words and fails the base rule; a null language or
source is a group of its own; groups below ``min_group`` distinct vectors use their language's
estimate, then the overall one; without any, the base rule alone decides; repeated rows are judged
one by one; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import free, refuse, small_batches, staged
from ._text import Words, column_bytes, count_by_doc, cover, mix64, slices

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
P = 5
ONE = 256  # fixed point of the transformed statistics
STARTS = 3
BINS = 64  # bins of an octave of squared distance
WINDOW = 16  # words that one repetition of a window marks at once, as both occurrences count
_HEAVY = np.zeros(256, bool)
_HEAVY[[ord(c) for c in SYMBOLS]] = True


def _dup_lines(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """(lines equal to an earlier line, lines) of each text, counting lines that hold a word."""
    dup, lines = [], []
    for text in texts:
        full = [x for x in (text or "").encode().split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines.append(len(full))
        dup.append(len(full) - len(set(full)))
    return dup, lines


def _stats(batch: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(text))
    buf, off = column_bytes(column)
    words = Words(buf, off)
    at, keys = words.windows(words.hashes(), 8)
    keys ^= mix64(words.doc[at].astype(np.uint64), 5)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    repeated = cover(at[order[twice]], 8, words.n)
    dup, lines = _dup_lines(column.to_pylist())
    return {
        "n_words": np.diff(words.doc_off),
        "word_chars": count_by_doc(words.ink & ((buf & 0xC0) != 0x80), off),
        "n_symbols": count_by_doc(_HEAVY[buf], off),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": count_by_doc(repeated, words.doc_off),
        "n_lines": np.array(lines, np.int64),
    }


def _transform(s: dict[str, np.ndarray]) -> np.ndarray:
    """Five statistics of each document as fixed-point integers."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    root = lambda part, whole: np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))
    x = [
        4 * np.log(np.log(s["n_words"] + math.e)),
        np.log(chars / words),
        root(s["n_symbols"], np.maximum(chars, s["n_symbols"])),
        root(s["n_dup_lines"], s["n_lines"]),
        root(s["n_repeat_words"], words),
    ]
    return np.rint(np.stack(x) * ONE).astype(np.int64)


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """docs with the base counts, lines and the transformed statistics x0..x4 as ``prefix`` columns."""
    names = [prefix + n for n in (*BASE, "n_lines", *(f"x{i}" for i in range(P)))]
    refuse(docs, *names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text):
                s = _stats(part, text)
                new = [*(s[n] for n in BASE), s["n_lines"], *_transform(s)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(a.astype(np.int64)) for a in new)], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function by the incomplete gamma series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a))) if z > 0 else 0.0


def chi2_quantile(p: float, k: int = P) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return hi


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SIZES = ("words", "chars", "lines")
_PARAMS = "grp string, start int, n long, center array<double>, precision array<double>, cov array<double>, logdet double, was double"


def chance(words: float, chars: float, lines: float) -> np.ndarray:
    """Variances that chance gives the statistics of a document of these counts."""
    return np.array([1 / ONE**2, 0.25 / max(words, 1), 0.25 / max(chars, 1), 0.25 / max(lines, 1), 0.25 / max(words / WINDOW, 1)])


def scatter(cov: np.ndarray, sizes: tuple[float, float, float]) -> np.ndarray:
    """The covariance, with variances that are below those of chance raised to these."""
    return cov + np.diag(np.maximum(chance(*sizes) - np.diag(cov), 0))


def _estimate(grp: str, start: int, n: int, center: np.ndarray, cov: np.ndarray, was: float) -> dict:
    """One row of estimates; ``was`` is the logarithm of the determinant before."""
    return {"grp": grp, "start": start, "n": n, "center": center.tolist(), "precision": np.linalg.inv(cov).ravel().tolist(), "cov": cov.ravel().tolist(), "logdet": float(np.linalg.slogdet(cov)[1]), "was": was}


def _distance(x: list[Column], params: str = "") -> Column:
    """Squared Mahalanobis distance of fixed-point x to the joined centre and precision."""
    diff = [x[i] / F.lit(float(ONE)) - F.col(f"{params}center")[i] for i in range(P)]
    return sum((F.col(f"{params}precision")[i * P + j] * diff[i] * diff[j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _group_keys(lang: Column, source: Column) -> list[Column]:
    """Keys from fine to coarse; JSON keeps null and odd values apart."""
    return [F.to_json(F.array(lang, source), {"ignoreNullFields": "false"}), F.to_json(F.array(lang), {"ignoreNullFields": "false"}), F.lit("[]")]


def first_estimates(median: np.ndarray, scale: np.ndarray, sign: np.ndarray, near: tuple[float, np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, covariance) of the starts.

    sign: sum of the outer products of the unit vectors of scaled deviations; near: number, sums
    and product sums of the scaled deviations in the nearest half.
    """
    d = np.sqrt(np.maximum(np.diag(sign), 1e-12))
    corr = sign / np.outer(d, d) * 0.999 + np.eye(P) * 0.001
    m, total, product = near
    mean = total / max(m, 1)
    half = (product / max(m, 1) - np.outer(mean, mean)) if m > P else np.eye(P)
    half = half + np.eye(P) * 1e-3  # some statistics may not vary in it
    return [(median, np.diag(scale**2)), (median, np.outer(scale, scale) * corr), (median + scale * mean, np.outer(scale, scale) * half)]


def concentrated(n: float, sums: np.ndarray, products: np.ndarray, sizes: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """(centre, scatter) of an h-subset of n documents from its sums of fixed-point statistics."""
    mean = sums / n / ONE
    cov = products / n / ONE**2 - np.outer(mean, mean)
    return mean, scatter(cov * (h / _chi2_cdf(chi2_quantile(h), P + 2)), tuple(sizes / n))


def fit(stats: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "q_", h: float = 0.75, steps: int = 20, min_group: int = 50, same: float = 1e-4) -> DataFrame:
    """MCD estimates: one row for each language and source, each language, and all documents.

    A group of ``min_group`` distinct statistic vectors at least is estimated by itself. A smaller one takes those of its vectors
    that its language's estimate holds within a chi-square share of 0.975, and is pooled with that estimate, which counts
    as ``min_group`` vectors; a small language is pooled with the estimate of all documents in the same way. So an estimate moves
    from the language's to the group's own as the group grows. With fewer than ``min_group`` vectors in all there is none.

    ``stats`` comes from with_statistics(); documents that fail the base rule take no part. After the
    two steps of all starts, at most ``steps`` more are taken, or until no logarithm of a determinant changes by over ``same``.
    """
    fine, wide, every = _group_keys(F.col(lang).cast("string"), F.col(source).cast("string"))
    keys = F.array(*(F.struct(own.alias("grp"), up.alias("parent")) for own, up in ((fine, wide), (wide, every), (every, F.lit(None).cast("string")))))
    xs = [f"x{i}" for i in range(P)]
    rows = stats.filter(~base_failed(prefix)).select(F.explode(keys).alias("g"), *(F.col(f"{prefix}{c}").alias(c) for c in xs), *(F.col(f"{prefix}{c}").alias(k) for k, c in zip(_SIZES, ("n_words", "word_chars", "n_lines"), strict=True)))
    rows = rows.groupBy(F.col("g.grp").alias("grp"), F.col("g.parent").alias("parent"), *xs).agg(*(F.max(c).alias(c) for c in _SIZES))
    distinct = rows = staged(rows, "mcd-vectors")
    large = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in _SIZES), *(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(xs))).filter(F.col("n") >= min_group)
    least = (F.lit(1 / ONE), *(0.5 / F.sqrt(F.greatest(m, F.lit(1.0))) for m in (F.col("mean_words"), F.col("mean_chars"), F.col("mean_lines"), F.col("mean_words") / WINDOW)))
    start = staged(large.select("grp", "n", F.array(*(F.col(f"q{i}")[1] / F.lit(float(ONE)) for i in range(P))).alias("median"), F.array(*(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / F.lit(1.349 * ONE), least[i]) for i in range(P))).alias("scale")), "mcd-start")
    rows = staged(rows.drop("parent").join(start.select("grp"), "grp", "left_semi"), "mcd-rows")

    # sums for the starts, of scaled deviations in fixed point
    z = [(F.col(c) / F.lit(float(ONE)) - F.col("median")[i]) / F.col("scale")[i] for i, c in enumerate(xs)]
    scaled = rows.join(start, "grp").select("grp", *(v.alias(f"z{i}") for i, v in enumerate(z)))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)))
    fixed = lambda v: F.sum(F.rint(v * F.lit(2.0**20)).cast("long"))
    inside = F.col("length") <= math.sqrt(chi2_quantile(0.5))
    scaled = scaled.withColumn("length", length)
    first = scaled.groupBy("grp").agg(
        F.sum(inside.cast("long")).alias("near"), *(fixed(F.when(inside, F.col(f"z{i}")).otherwise(0.0)).alias(f"n{i}") for i in range(P)),
        *(fixed(F.when(inside, F.col(f"z{i}") * F.col(f"z{j}")).otherwise(0.0)).alias(f"n{i}{j}") for i, j in _PAIRS),
        *(fixed(F.when(F.col("length") > 0, F.col(f"z{i}") * F.col(f"z{j}") / (F.col("length") * F.col("length"))).otherwise(0.0)).alias(f"s{i}{j}") for i, j in _PAIRS),
    ).join(start, "grp")

    def square(row, name: str) -> np.ndarray:
        out = np.zeros((P, P))
        for i, j in _PAIRS:
            out[i, j] = out[j, i] = float(row[f"{name}{i}{j}"])
        return out

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                near = (float(r["near"]), np.array([r[f"n{i}"] for i in range(P)], float) / 2**20, square(r, "n") / 2**20)
                pairs = first_estimates(np.array(r["median"], float), np.array(r["scale"], float), square(r, "s") / 2**20, near)
                out += [_estimate(r["grp"], k, int(r["n"]), *p, math.inf) for k, p in enumerate(pairs)]
            if out:
                yield pd.DataFrame(out)

    def concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        cnt = pdf["cnt"].to_numpy(float)
        n = int(cnt.sum())
        want = math.ceil(h * n)
        share = np.clip((want - (np.cumsum(cnt) - cnt)) / cnt, 0, 1)  # the bin in which the subset ends counts in part
        s = {c: float((pdf[c].to_numpy(float) * share).sum()) for c in pdf.columns if c not in ("grp", "start", "bin", "logdet")}
        center, cov = concentrated(want, np.array([s[f"s{i}"] for i in range(P)]), square(s, "s"), np.array([s[c] for c in _SIZES]), h)
        return pd.DataFrame([_estimate(pdf["grp"].iloc[0], int(pdf["start"].iloc[0]), n, center, cov, float(pdf["logdet"].iloc[0]))])

    def step(params: DataFrame) -> DataFrame:
        x = [F.col(c) for c in xs]
        near = F.floor(F.log2(F.greatest(_distance(x), F.lit(2.0**-10))) * BINS).cast("int")
        sums = rows.join(params, "grp").withColumn("bin", near).groupBy("grp", "start", "logdet", "bin").agg(
            F.count(F.lit(1)).alias("cnt"),
            *(F.sum(v).alias(f"s{i}") for i, v in enumerate(x)),
            *(F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in _PAIRS),
            *(F.sum(c).alias(c) for c in _SIZES),
        )
        # written out, the few estimates have a known size, and Spark broadcasts them if it is small
        return staged(sums.groupBy("grp", "start").applyInPandas(concentrate, _PARAMS), "mcd-params")

    params = step(step(staged(first.mapInPandas(begin, _PARAMS), "mcd-params")))
    best = params.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    params = staged(params.join(best, ["grp", "start"]).select(*params.columns), "mcd-params")
    for _ in range(steps):
        params = step(params)
        if params.filter(F.abs(F.col("logdet") - F.col("was")) > same).isEmpty():
            break
    params = params.select("grp", "n", "center", "precision", "cov")
    for own in (F.col("parent") == "[]", F.col("parent") != "[]"):  # languages, then languages with their source
        params = staged(params.unionByName(_pooled(distinct.filter(own), params, xs, min_group)), "mcd-params")
    return params


def _pooled(rows: DataFrame, params: DataFrame, xs: list[str], strength: int) -> DataFrame:
    """Estimates of the groups of ``rows`` that have none yet, pooled with those of their parents, which count as ``strength`` vectors."""
    small = rows.join(params.select("grp"), "grp", "left_anti").join(params.select(F.col("grp").alias("parent"), "center", "precision", "cov"), "parent")
    x = [F.col(c) for c in xs]
    inside = (_distance(x) <= chi2_quantile(0.975)).cast("long")
    sums = small.withColumn("in", inside).groupBy("grp").agg(
        F.count(F.lit(1)).alias("all"), F.sum("in").alias("n"), F.first("center").alias("center"), F.first("cov").alias("cov"),
        *(F.sum(v * F.col("in")).alias(f"s{i}") for i, v in enumerate(x)), *(F.sum(x[i] * x[j] * F.col("in")).alias(f"s{i}{j}") for i, j in _PAIRS),
        *(F.sum(F.col(c) * F.col("in")).alias(c) for c in _SIZES),
    )

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                n, center, cov = float(r["n"]), np.array(r["center"], float), np.array(r["cov"], float).reshape(P, P)
                if n:
                    mean = np.array([r[f"s{i}"] for i in range(P)], float) / n / ONE
                    own = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(P)] for i in range(P)], float) / n / ONE**2 - np.outer(mean, mean)
                    apart = mean - center
                    cov = (n * own + strength * cov) / (n + strength) + np.outer(apart, apart) * n * strength / (n + strength) ** 2
                    cov = scatter(cov, tuple(float(r[c]) / n for c in _SIZES))
                    center = center + apart * n / (n + strength)
                out.append({"grp": r["grp"], "n": int(r["all"]), "center": center.tolist(), "precision": np.linalg.inv(cov).ravel().tolist(), "cov": cov.ravel().tolist()})
            if out:
                yield pd.DataFrame(out)

    return sums.mapInPandas(pool, "grp string, n long, center array<double>, precision array<double>, cov array<double>")


def base_failed(prefix: str = "q_") -> Column:
    return (F.col(f"{prefix}n_words") < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * F.col(f"{prefix}n_words"))


def judge(stats: DataFrame, params: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "q_", tail: float = 1e-6) -> DataFrame:
    """stats with ``prefix``distance (double, null where no estimate exists) and ``prefix``kept.

    A document is judged by its finest group that has an estimate. ``tail`` is the chi-square
    probability of rejecting a document that follows the group's law.
    """
    cut = chi2_quantile(1 - tail)
    x = [F.col(f"{prefix}x{i}") for i in range(P)]
    out = stats
    params = staged(params, "mcd-params")
    names = []
    for key in _group_keys(F.col(lang).cast("string"), F.col(source).cast("string")):
        grp = free(out, "__grp")
        names.append(free(out, "__estimate"))
        out = out.join(params.select(F.col("grp").alias(grp), F.struct("center", "precision").alias(names[-1])), key == F.col(grp), "left")
    d2 = F.coalesce(*(F.when(F.col(n).isNotNull(), _distance(x, f"{n}.")) for n in names))
    kept = ~base_failed(prefix) & ~F.coalesce(d2 > cut, F.lit(False))
    return out.select(*(F.col(f"`{c}`") for c in stats.columns), d2.alias(f"{prefix}distance"), kept.alias(f"{prefix}kept"))


def op1_quality_mcd(spark, sf_dir: str) -> DataFrame:
    """Every document with its base counts, base verdict and the MCD verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    stats = staged(with_statistics(docs).drop("text"), "mcd-stats")
    out = judge(stats, fit(stats))
    return out.select("doc_id", *(F.col(f"q_{n}").alias(n) for n in BASE), base_failed().alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_distance").alias("distance"))


def pipeline_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    prefix = "__q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    stats = with_statistics(docs, prefix=prefix)
    slim = staged(stats.select("lang", "source", *(c for c in stats.columns if c.startswith(prefix))), "mcd-stats")
    return judge(stats, fit(slim, prefix=prefix), prefix=prefix).filter(f"`{prefix}kept`").select(*(F.col(f"`{c}`") for c in docs.columns))
