"""Mixing sources to target weights by subset-sum budget fitting.

1. *Lengths*: documents are tokenized once with a public tokenizer (whole texts, Arrow batches); only id, source and
   exact token length are kept.
2. *Counts by length*: documents per source and exact token length. The counts, not the documents, are what the
   budget is fitted on; lengths are bounded by the longest text.
3. *Budget*: a source with target share w has the budget ``round(w * total)``. Whole repeats of the source fill it as far
   as they fit (at most ``max_repeats``); a source that can't fill it is *short* and enters ``max_repeats`` times.
   Of the remaining budget, every length gives its share of documents from the longest to the shortest, carrying
   fractions on; a bounded-knapsack dynamic program over documents that are added or given back then fits the budget as closely as the
   lengths allow. What a source's plan leaves of its budget although every document enters ``max_repeats`` times makes it short.
4. *Selection*: of each source and length, the planned number of documents is selected in the order of a seeded
   hash. A length that holds very many documents is cut by hash slices: slices below the
   boundary are taken whole, and only the boundary slice is ranked.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from histolith.session import spread, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern that splits text before the merges of that vocabulary (fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Window of the budget fit in longest lengths.
WIDEST = 512
#: Hash slices of a (source, length).
SLICES = 1024


def _encoder(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(texts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``texts(id, source, text)`` to ``(id, source, tokens)``; a null or empty text has 0 tokens. The vocabulary is read by the
    driver and travels with the tasks."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(n, pa.int64())], names=["id", "source", "tokens"])

    kinds = dict(texts.dtypes)
    return spread(texts.select("id", "source", "text")).mapInArrow(run, f"id {kinds['id']}, source string, tokens long")


def canonical_source(source: Column) -> Column:
    return F.translate(F.lower(F.trim(source)), "-", "_")


def _parts(count: int) -> list[int]:
    """Numbers that add up to every number of 0 to ``count`` (bounded knapsack by doubling)."""
    out, k = [], 1
    while count > 0:
        out.append(min(k, count))
        count -= out[-1]
        k *= 2
    return out


def _exchanged(reach: int, n: int, more: int, fewer: int, mask: int) -> int:
    """Sums as bits, with up to so many documents of n tokens more or fewer."""
    up = down = reach
    for k in _parts(more):
        up |= (up << (n * k)) & mask
    for k in _parts(fewer):
        down |= down >> (n * k)
    return up | down


def _fit(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Number of documents of each (length, count) so that their total is as close below ``budget`` as can be.

    Every length first gives its proportional share; a bounded-knapsack program over documents that are added or given back then fits
    the rest. Sums are kept as bits of a window around the share. An exact fit can't be bettered; without one the window grows until it holds
    all documents, twice the square of the longest length L (no exchange needs more: of over L documents on either side some have equal sums and
    cancel) or ``WIDEST`` longest lengths. Up to there the fit is the best there is; beyond, which takes L over WIDEST / 2 and lengths that
    all but a few documents share a divisor of, it is the best exchange of that size.
    """
    whole = sorted((n, c) for n, c in lengths if n > 0 and c > 0)[::-1]
    if budget >= sum(n * c for n, c in whole):
        return dict(whole)
    unit = math.gcd(*(n for n, _ in whole))
    own, budget = [(n // unit, c) for n, c in whole], budget // unit
    total = sum(n * c for n, c in own)
    share, carry = [], 0  # exact arithmetic: carry is in units of 1 / total
    for n, c in own:
        due = c * budget * n + carry
        share.append(min(c, due // (n * total)))
        carry = due - share[-1] * n * total
    left = budget - sum(n * k for (n, _), k in zip(own, share))
    longest, block = own[0][0], max(1, math.isqrt(len(own)))
    bound = max(min(2 * longest * longest, total, WIDEST * longest), left)
    width = min(bound, max(4 * longest, left))
    step = lambda reach, x: _exchanged(reach, x[0][0], min(x[0][1] - x[1], 2 * width // x[0][0]), min(x[1], 2 * width // x[0][0]), (1 << (2 * width + 1)) - 1)
    steps = list(zip(own, share))
    while True:
        reach, kept = 1 << width, []
        for i, x in enumerate(steps):
            if i % block == 0:
                kept.append(reach)
            reach = step(reach, x)
        at = (reach & ((1 << (width + left + 1)) - 1)).bit_length() - 1
        if at == width + left or width == bound:
            break
        width = min(bound, 8 * width)
    # the way back, block by block
    for b in reversed(range(len(kept))):
        before = [kept[b]]
        for x in steps[b * block : (b + 1) * block]:
            before.append(step(before[-1], x))
        for i in reversed(range(b * block, min(len(own), (b + 1) * block))):
            (n, c), now = own[i], before[i - b * block]
            tries = (j for k in range(2 * width // n + 1) for j in (k, -k))
            j = next(j for j in tries if -share[i] <= j <= c - share[i] and at >= n * j and now >> (at - n * j) & 1)
            share[i] += j
            at -= n * j
    return {n: k for (n, _), k in zip(whole, share)}


def fit_mixture(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """The plan: ``(source, tokens, n, whole, extra)`` per source and length; every document enters ``whole`` times and
    ``extra`` of them once more.

    ``sized(id, source, tokens)``, ``targets(source, target_share, max_repeats)``; total defaults to the tokens of all
    documents of ``sized``, of targets or not. Sources without a target and null sources are left out; a source has at most one target;
    without documents there is no plan.
    """
    counts = written(sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    if total is None:
        total = counts.agg(F.coalesce(F.sum(F.col("tokens") * F.col("n")), F.lit(0)).alias("t")).first().t
    goal = F.round(F.col("target_share") * F.lit(total)).cast("long")
    plan = counts.join(targets.select("source", goal.alias("goal"), F.col("max_repeats").cast("long").alias("cap")), "source")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per length: bounded by the longest text, not by the documents
        goal, cap = int(pdf.goal.iloc[0]), int(pdf.cap.iloc[0])
        size = int((pdf.tokens * pdf.n).sum())
        whole = min(cap, goal // size) if size else cap
        take = _fit(list(zip(pdf.tokens.tolist(), pdf.n.tolist())), goal - whole * size) if whole < cap else {}
        return pd.DataFrame({"source": pdf.source, "tokens": pdf.tokens, "n": pdf.n, "whole": whole, "extra": [take.get(t, 0) for t in pdf.tokens.tolist()]})

    return plan.groupBy("source").applyInPandas(one, "source string, tokens long, n long, whole long, extra long")


def select_documents(sized: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``(id, source, tokens, times)``: how often each document enters the mixture (0 times: left out).

    One row per row of ``sized`` with a source in the plan; rows with the same id and hash are told apart by their order only.
    """
    h = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    rows = sized.select("id", "source", "tokens").withColumn("h", h).withColumn("slice", F.pmod(F.shiftright("h", 20), F.lit(SLICES)).cast("int"))
    by_slice = rows.groupBy("source", "tokens", "slice").agg(F.count(F.lit(1)).alias("k"))
    below = F.coalesce(F.sum("k").over(W.partitionBy("source", "tokens").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quota = by_slice.withColumn("below", below).join(plan.select("source", "tokens", "whole", "extra"), ["source", "tokens"])
    quota = quota.select("source", "tokens", "slice", "k", "whole", F.greatest(F.lit(0), F.least("k", F.col("extra") - F.col("below"))).alias("q"))
    rows = rows.join(quota, ["source", "tokens", "slice"])
    clear = rows.where("q = 0 OR q = k").withColumn("times", F.col("whole") + (F.col("q") > 0).cast("long"))
    rank = F.row_number().over(W.partitionBy("source", "tokens", "slice").orderBy("h", "id"))
    edge = rows.where("q > 0 AND q < k").withColumn("r", rank).withColumn("times", F.col("whole") + (F.col("r") <= F.col("q")).cast("long"))
    cols = ["id", "source", "tokens", "times"]
    return clear.select(*cols).unionByName(edge.select(*cols))


def shares(plan: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """Report per target: ``(source, target_share, max_repeats, size, used, reached_share, short)``.

    ``total``: tokens of all documents, of targets or not; reached_share is of the tokens used by all sources. A target without
    documents has size 0 and is short if its share is over 0. ``short``: the plan uses every document max_repeats times and still
    falls below the target's share of all tokens.
    """
    own = plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("size"), F.sum(F.col("tokens") * (F.col("n") * F.col("whole") + F.col("extra"))).alias("used"), F.min("whole").alias("least"))
    all_used = own.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("u")).first().u
    out = targets.select("source", "target_share", "max_repeats").join(own, "source", "left").fillna(0, ["size", "used"])
    short = (F.col("used") < F.col("target_share") * F.lit(total)) & (F.coalesce("least", "max_repeats") >= F.col("max_repeats"))
    reached = F.when(F.lit(all_used > 0), F.col("used") / F.lit(max(1, all_used))).otherwise(F.lit(0.0))
    return out.select("source", "target_share", "max_repeats", "size", "used", reached.alias("reached_share"), short.alias("short"))
