"""Repetition inside a single document: robust multivariate outliers.

1. *Statistics* of each whole text, in ``[0, 1]``: words in repeated runs of five, characters in repeated lines, characters
   in repeated sentences, and words beyond the distinct word trigrams; variance-stabilised by ``asin(sqrt(x))``.
2. *Groups*: language and source. Groups under ``SMALL`` documents are pooled by language, and what is then still small
   in one rest; all texts together are a group as well. Equal vectors of a group are counted once with their number, so every estimate rests on
   all rows.
3. *Minimum covariance determinant* per group, regularised by ``FLOOR`` (most texts repeat nothing, so half of a group may have no scatter at
   all). ``STARTS`` starts, medians and random handfuls, are improved by concentration steps: the half of the group that is nearest in
   Mahalanobis distance gives the next centre and scatter, until the determinant no longer falls; the start with the smallest one is kept. A step is
   one aggregation over all rows: sums and products by classes of distance, of which the classes of the nearest half are taken, the last in part.
4. *Rejection*: texts whose squared distance from their own group, or from all texts, exceeds ``CUT``.

The estimate decides: where more than half of a group *and* of all texts repeat themselves, repetition is what is usual, and no robust
estimate rejects it (the breakdown point).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from histolith.session import spread, written

#: Share from which a text mainly repeats itself.
MAINLY = 0.35
#: 0.975 quantile of chi-squared with four degrees of freedom.
CUT = 11.143
#: Factor that makes the scatter of the nearest half consistent for a normal distribution of four dimensions.
CONSISTENT = 2.11
#: Standard deviation of the regularisation.
FLOOR = 0.08
SMALL = 50
STARTS, HANDFUL = 4, 6
#: Least fall of the logarithm of the determinant that is worth a further step.
FALL = 1e-3
#: Groups whose estimates may be broadcast.
FEW = 20_000
#: Bytes of text that are measured at a time.
BYTES = 1 << 23
ALL = "**"

STATS = ("repeated_words", "repeated_lines", "repeated_sentences", "repeated_trigrams")
D = range(len(STATS))
PAIRS = [(i, j) for i in D for j in D if i <= j]

# statistics -------------------------------------------------------------------------------------------


def _split(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """Pieces between matches in a row, and the text of each."""
    parts = pc.split_pattern_regex(texts, pattern)
    pieces = pc.utf8_trim_whitespace(pc.list_flatten(parts))
    real = pc.not_equal(pieces, "")
    return pieces.filter(real), pc.list_parent_indices(parts).filter(real).to_numpy()


def _again(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the same key came before in the same text."""
    order = np.lexsort((key, of))  # stable: equal ones stay in order
    k, t = key[order], of[order]
    out = np.zeros(len(key), bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    return out


def _runs(words: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where runs of n words of one text begin, and whether the run came before: 64-bit codes of numbers of words."""
    k = max(0, len(words) - n + 1)
    at = np.flatnonzero(of[:k] == of[n - 1 : n - 1 + k])
    code = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[at + j].astype(np.uint64) + np.uint64(1)
    return at, _again(code, of[at])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def statistics(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words and STATS of each text; a text without words has shares of 0."""
    t = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    n = len(t)
    words, of = _split(t, r"[^\p{L}]+")
    words = words.dictionary_encode().indices.to_numpy()
    count = np.bincount(of, minlength=n)
    at, again = _runs(words, of, 5)
    edge = np.zeros(len(words) + 6, np.int64)
    edge[at[again]] += 1
    edge[at[again] + 5] -= 1
    covered = np.cumsum(edge)[: len(words)] > 0
    out = [_share(np.bincount(of, covered, n), count)]
    for pattern in (r"\n", r"[.!?\n]+"):
        pieces, p = _split(t, pattern)
        size = pc.utf8_length(pieces).to_numpy()
        out.append(_share(np.bincount(p, size * _again(pieces.dictionary_encode().indices.to_numpy(), p), n), np.bincount(p, size, n)))
    at, again = _runs(words, of, 3)
    out.append(_share(np.bincount(of[at], again, n), np.maximum(count - 2, 0)))
    return count, out


def repeated_words(words: list[str]) -> float:
    """Share of words that lie in a run of five which also begins at an earlier word."""
    return float(statistics(pa.array([" ".join(words)], pa.string()))[1][0][0])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BYTES)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
            part = batch.slice(lo, hi - lo)
            if hi > lo:
                count, stats = statistics(part.column("text"))
                columns = [part.column("id"), part.column("lang"), part.column("source"), pa.array(count.astype(np.int32)), *map(pa.array, stats)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "source", "words", *STATS])


def measured(texts: DataFrame) -> DataFrame:
    """``texts(id, lang, source, text)`` to ``(id, lang, source, words, *STATS)``; a text without words has shares of 0."""
    kind = dict(texts.dtypes)["id"]
    shape = f"id {kind}, lang string, source string, words int, " + ", ".join(f"{s} double" for s in STATS)
    return spread(texts.select("id", "lang", "source", "text")).mapInArrow(_measure, shape)


# minimum covariance determinant -----------------------------------------------------------------------

X, M, V = [f"x{i}" for i in D], [f"m{i}" for i in D], [f"v{i}{j}" for i, j in PAIRS]
ESTIMATE = "grp string, start int, " + ", ".join(f"{c} double" for c in [*M, *V]) + ", logdet double, fell double"


def _invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean values and products per group and start to centre, inverse scatter, determinant and how far it fell."""
    for pdf in frames:
        n = len(pdf)
        mean = pdf[M].to_numpy(float)
        cov = np.zeros((n, len(D), len(D)))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = pdf[f"c{i}{j}"].to_numpy(float) - mean[:, i] * mean[:, j]
        cov = CONSISTENT * cov + FLOOR**2 * np.eye(len(D))
        inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        cols = {"grp": pdf["grp"], "start": pdf["start"]} | {m: mean[:, i] for i, m in enumerate(M)} | {f"v{i}{j}": inverse[:, i, j] for i, j in PAIRS}
        yield pd.DataFrame(cols | {"logdet": logdet, "fell": pdf["was"].to_numpy(float) - logdet})


def _moments(weight: Column) -> list[Column]:
    """Weighted sums of the statistics and their products."""
    return [F.sum(weight * F.col(x)).alias(m) for x, m in zip(X, M)] + [F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i, j in PAIRS]


SUMS = [*M, *(f"c{i}{j}" for i, j in PAIRS)]


def _estimates(sums: DataFrame) -> DataFrame:
    """(grp, start, n, was, SUMS) to ESTIMATE."""
    return sums.select("grp", "start", "was", *[(F.col(c) / F.col("n")).alias(c) for c in SUMS]).mapInPandas(_invert, ESTIMATE)


def _with(rows: DataFrame, per_group: DataFrame, small: bool | None = None) -> DataFrame:
    """Join per-group rows to their documents: by broadcast where there are FEW of them (``small``, if known), else by shuffle."""
    if small is None:
        small = per_group.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(per_group) if small else per_group, "grp")


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in D]
    return sum((d[i] * d[j] * F.col(f"v{i}{j}") * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _starts(vectors: DataFrame, seed: int) -> DataFrame:
    """First estimates: start 0 from the medians, each other one from a random handful of the group."""
    # weighted medians by classes of 1 / 256
    cells = vectors.select("grp", "n", F.posexplode(F.array(*[F.floor(F.col(x) * 256) for x in X])).alias("i", "cls")).groupBy("grp", "i", "cls").agg(F.sum("n").alias("n"))
    own = W.partitionBy("grp", "i")  # at most some hundred classes
    cells = cells.withColumn("upto", F.sum("n").over(own.orderBy("cls"))).withColumn("all", F.sum("n").over(own)).where(F.col("upto") * 2 >= F.col("all"))
    middle = cells.groupBy("grp", "i").agg(((F.min("cls") + 0.5) / 256).alias("e")).groupBy("grp").agg(*[F.max(F.when(F.col("i") == i, F.col("e"))).alias(f"e{i}") for i in D])
    middle = written(middle.join(vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("k")), "grp"), "median")
    both = _with(vectors, middle)
    # the half of each group that is nearest to the medians in the largest coordinate, by the same classes
    off = F.greatest(*[F.abs(F.col(f"x{i}") - F.col(f"e{i}")) for i in D])
    near = both.withColumn("off", off)
    rings = near.groupBy("grp", F.floor(F.col("off") * 256).alias("cls")).agg(F.sum("n").alias("n"))
    own = W.partitionBy("grp")
    rings = rings.withColumn("upto", F.sum("n").over(own.orderBy("cls"))).withColumn("all", F.sum("n").over(own)).where(F.col("upto") * 2 >= F.col("all"))
    bound = written(rings.groupBy("grp").agg(F.min("cls").alias("bound")), "near")
    zero = _with(near.select("grp", "n", *X, "off"), bound).where("off * 256 < bound + 1").withColumn("start", F.lit(0))
    # handfuls: rows under a hash bound that leaves a few times as many as are needed, then in order of the hash
    need = HANDFUL * (STARTS - 1)
    h = F.pmod(F.xxhash64(F.lit(seed), "grp", *X), F.lit(1 << 40))
    few = both.withColumn("h", h).where(F.col("h") * F.col("k") < F.lit(8 * need) * F.lit(1 << 40))
    rank = F.row_number().over(W.partitionBy("grp").orderBy("h", *X))
    hands = few.withColumn("r", rank).where(F.col("r") <= need).withColumn("start", (1 + (F.col("r") - 1) / HANDFUL).cast("int")).withColumn("n", F.lit(1))
    rows = zero.select("grp", "start", "n", *X).unionByName(hands.select("grp", "start", "n", *X))
    sums = rows.groupBy("grp", "start").agg(F.sum("n").alias("n"), F.lit(math.inf).alias("was"), *_moments(F.col("n")))
    return _estimates(sums).withColumn("logdet", F.lit(math.inf))  # of a part that isn't half of the group, so no mark to fall from


def _concentrated(vectors: DataFrame, estimate: DataFrame, small: bool) -> DataFrame:
    """One concentration step for all groups and starts."""
    d2 = _distance()
    cells = _with(vectors, estimate, small).withColumn("cls", F.floor(64 * F.log1p(16 * F.greatest(d2, F.lit(0.0)))).cast("int"))
    cells = cells.groupBy("grp", "start", "cls").agg(F.sum("n").alias("n"), F.first("logdet").alias("was"), *_moments(F.col("n")))
    own = W.partitionBy("grp", "start")  # at most some hundred classes
    before = F.coalesce(F.sum("n").over(own.orderBy("cls").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    half = (F.sum("n").over(own) + len(D) + 1) / 2
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (half - before) / F.col("n")))
    kept = cells.withColumn("f", part).where("f > 0").groupBy("grp", "start")
    return _estimates(kept.agg(F.sum(F.col("f") * F.col("n")).alias("n"), F.first("was").alias("was"), *[F.sum(F.col("f") * F.col(c)).alias(c) for c in SUMS]))


def minimum_determinant(vectors: DataFrame, seed: int = 5) -> DataFrame:
    """``vectors(grp, n, x0..x3)``, n times each, to one estimate a group: ``(grp, m0.., v00.., logdet)``."""
    now = written(_starts(vectors, seed), "estimate")
    small = now.limit(FEW + 1).count() <= FEW
    done: list[DataFrame] = []
    while True:
        after = written(_concentrated(vectors, now.drop("fell"), small), "estimate")
        done.append(after.where(f"fell <= {FALL}"))
        now = after.where(f"fell > {FALL}")
        if now.limit(1).count() == 0:
            break
    best = reduce(DataFrame.unionByName, done).groupBy("grp").agg(F.min_by(F.struct(*M, *V, "logdet"), F.struct("logdet", "start")).alias("b"))
    return written(best.select("grp", "b.*"), "determinant")


def outliers(stats: DataFrame) -> DataFrame:
    """Rows of ``measured`` with their group ``grp``, squared robust distances ``d2`` from their group and ``d2_all`` from all texts, and ``rejected``.

    Language and source are compared trimmed and in lower case, null ones as ``''``. An empty table gives no rows.
    """
    clean = lambda c: F.translate(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), "-", "_")
    rows = written(stats.withColumn("_l", clean("lang")).withColumn("_s", clean("source")).select("*", *[F.asin(F.sqrt(F.col(s))).alias(f"x{i}") for i, s in enumerate(STATS)]), "stats")
    pairs = rows.groupBy("_l", "_s").count()
    big = pairs.where(F.col("count") >= SMALL).select("_l", "_s", F.concat_ws("|", "_l", "_s").alias("own"))
    rest = pairs.join(big, ["_l", "_s"], "left_anti").groupBy("_l").agg(F.sum("count").alias("n")).where(F.col("n") >= SMALL).select("_l", F.concat("_l", F.lit("|*")).alias("pooled"))
    names = written(pairs.join(big, ["_l", "_s"], "left").join(rest, "_l", "left").select("_l", "_s", F.coalesce("own", "pooled", F.lit("*|*")).alias("grp")), "groups")
    named = rows.join(F.broadcast(names) if names.limit(FEW + 1).count() <= FEW else names, ["_l", "_s"]).drop("_l", "_s")
    own = named.groupBy("grp", *X).agg(F.count(F.lit(1)).alias("n"))
    vectors = written(own, "vectors")
    everything = vectors.groupBy(F.lit(ALL).alias("grp"), *X).agg(F.sum("n").alias("n"))
    vectors = written(vectors.unionByName(everything), "vectors")
    estimate = minimum_determinant(vectors)
    out = _with(named, estimate.where(F.col("grp") != ALL).drop("logdet"))
    out = out.select("id", "lang", "source", "words", *STATS, "grp", *X, _distance().alias("d2"))
    one = estimate.where(F.col("grp") == ALL).first()
    if one is None:
        return out.drop(*X).withColumn("d2_all", F.lit(0.0)).withColumn("rejected", F.lit(False))
    for c in (*M, *V):
        out = out.withColumn(c, F.lit(one[c]))
    out = out.withColumn("d2_all", _distance()).drop(*X, *M, *V)
    return out.withColumn("rejected", (F.col("d2") > CUT) | (F.col("d2_all") > CUT))


def self_repeating(texts: DataFrame) -> DataFrame:
    """Texts that mainly repeat themselves: rejected by their robust distance, and verified to have ``MAINLY`` or more of their
    words in repeated runs. Null, empty and short texts are never among them. What the estimate doesn't reject isn't reported
    (see the breakdown point above)."""
    return outliers(measured(texts)).where(F.col("rejected") & (F.col("repeated_words") >= MAINLY))
