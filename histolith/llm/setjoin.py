"""All similar pairs between set-valued records: extended-prefix join.

Two sets with at least ``o`` common members share at least ``l`` tokens of their first ``size - o + l`` tokens under
any one order of all tokens. So every set is announced under all combinations of ``l`` tokens of its extended
prefix; sets that meet under a combination are candidates, which are verified by their exact overlap. A longer
prefix (larger ``l``) costs more announcements and gives far fewer candidates.

* *Order*: rare tokens first. Frequencies come from a count sketch of ``SKETCH`` counters, the only thing that
  is collected; its size doesn't depend on the data. (Any total order gives the same pairs.)
* *Length-aware prefixes*: the larger set of a pair probes, the smaller is indexed. A set of n tokens has partners
  of down to ``t n`` tokens when it probes, so its probe prefix needs ``o = ceil(t n)``; as the smaller one it needs
  ``o = ceil(2 t / (1 + t) n)``, a shorter prefix.
* *Adaptive*: each probing set picks the ``l`` with the least expected work (announcements plus the sketched length
  of the lists it meets). A set is indexed under the ``l`` that sets of a partner's size do pick; an l under which a set of that size would be
  indexed more than ``MOST`` times is not picked (indexing all partners costs more than a longer prefix saves).
* *Equal sets* are one class: only classes are joined, and membership is joined back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from histolith.session import forget, spread, written

#: Counters of the frequency sketch: a fixed size.
SKETCH = 1 << 16
#: Tokens of a combination, and the most combinations of two tokens or more that a set is indexed under.
LENGTHS, MOST = (1, 2, 3), 128


def _least_common(n: int, m: int, num: int, den: int) -> int:
    """Fewest common members of sets of n and m members with Jaccard similarity >= num / den."""
    return -(-num * (n + m) // (num + den))


def _picks(sketch: np.ndarray, num: int, den: int):
    """A function of batches (cid, tokens) to their sets ``(cid, n, tokens rare first, l)``, l being what the set picks as it probes."""

    def open_to(l: int, n: int) -> bool:
        """Whether sets of n members may pick l; what holds for n holds for all smaller partners."""
        return l == 1 or l <= n and math.comb(n - max(_least_common(n, n, num, den), l) + l, l) <= MOST

    def run(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[int], int]]:
        tokens = batch.column("tokens")
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
        hashes = pc.list_flatten(tokens).to_numpy()
        ends = np.cumsum(sizes)
        freq = sketch[(hashes & (SKETCH - 1))]
        parent = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((hashes, freq, parent))
        hashes, freq = hashes[order], freq[order]
        for cid, n, lo in zip(batch.column("cid").to_pylist(), sizes.tolist(), (ends - sizes).tolist()):
            f, o = freq[lo : lo + n].tolist(), -(-num * n // den)
            best, pick = math.inf, 1
            for l in LENGTHS:
                if l > o or not open_to(l, n):
                    continue
                p = f[: n - o + l]
                # list met under a combination: no longer than that of its rarest token, which is thinned
                # by each further token about as its frequency says
                work = sum(f_i * (math.comb(len(p) - i - 1, l - 1) if l > 1 else 1) / (4.0 ** (l - 1)) for i, f_i in enumerate(p)) + 3 * math.comb(len(p), l)
                if work < best:
                    best, pick = work, l
            yield cid, n, hashes[lo : lo + n].tolist(), pick

    return run


def _picked(sets):
    """Batches to the distinct (l, n) that their sets pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted({(l, n) for _, n, _, l in sets(batch)})
            yield pa.RecordBatch.from_arrays([pa.array([l for l, _ in pairs], pa.int32()), pa.array([n for _, n in pairs], pa.int32())], names=["l", "n"])

    return run


def _announce(sets, picked: dict[int, np.ndarray], num: int, den: int):
    """A function of batches (cid, tokens) to batches (sig, l, cid, size, probe). ``picked``: sizes of sets that pick l, sorted."""

    def wanted(l: int, n: int) -> bool:
        """Whether a set that picks l may be a larger partner of one of n members."""
        own = picked[l]
        at = int(np.searchsorted(own, n))
        return at < len(own) and num * int(own[at]) <= n * den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig: list[int] = []
            rows: list[tuple[int, int, int, bool]] = []
            for cid, n, h, pick in sets(batch):
                o_probe, o_index = -(-num * n // den), _least_common(n, n, num, den)
                for c in combinations(h[: n - o_probe + pick], pick):
                    sig.append(hash((pick, *c)))
                    rows.append((pick, cid, n, True))
                for l in LENGTHS:
                    # a partner that picks l has l common members with this set, or is none
                    if l <= n and wanted(l, n):
                        for c in combinations(h[: n - max(o_index, l) + l], l):
                            sig.append(hash((l, *c)))
                            rows.append((l, cid, n, False))
            if rows:
                l, cid, n, probe = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(l, pa.int32()), pa.array(cid, pa.int64()), pa.array(n, pa.int32()), pa.array(probe, pa.bool_())], names=["sig", "l", "cid", "size", "probe"])

    return run


def set_classes(records: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Written tables ``classes(kind, cid, rep, items, tokens)`` of the distinct sets of ``min_size`` members or more and
    ``members(kind, cid, key)``. Copies of a key are united."""
    items = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t.isNotNull())
    once = records.where("key IS NOT NULL").select("kind", "key", F.array_sort(F.array_distinct(items)).alias("items"))
    once = once.groupBy("kind", "key").agg(F.collect_set("items").alias("s"))
    united = F.when(F.size("s") == 1, F.element_at("s", 1)).otherwise(F.array_sort(F.array_distinct(F.flatten("s"))))
    once = written(once.select("kind", "key", united.alias("items")).where(F.size("items") >= min_size), "sets")
    reps = once.groupBy("kind", "items").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    tokens = F.transform("items", lambda t: F.xxhash64("kind", t))
    classes = written(reps.select("kind", "rep", "copies", "items", tokens.alias("tokens")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = once.join(classes.where("copies > 1").select("kind", "items", "cid"), ["kind", "items"]).select("kind", "cid", "key")
    members = written(classes.where("copies = 1").select("kind", "cid", F.col("rep").alias("key")).unionByName(members), "members")
    forget(once)
    return classes, members


def similar_classes(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(kind, a, b, common, union)`` of class ids, the larger set (ties: the smaller id) as ``a``."""
    counted = classes.select(F.explode("tokens").alias("t")).groupBy(F.expr(f"cast(t & {SKETCH - 1} as int)").alias("slot")).count()
    sketch = np.zeros(SKETCH, np.int64)
    for slot, n in counted.collect():  # SKETCH rows at most
        sketch[slot] = n
    sets = _picks(sketch, num, den)
    picked: dict[int, list[int]] = {l: [] for l in LENGTHS}
    for r in classes.select("cid", "tokens").mapInArrow(_picked(sets), "l int, n int").distinct().orderBy("l", "n").collect():  # distinct sizes of sets
        picked[r.l].append(r.n)
    known = {l: np.array(n, np.int64) for l, n in picked.items()}
    rows = written(spread(classes.select("cid", "tokens")).mapInArrow(_announce(sets, known, num, den), "sig long, l int, cid long, size int, probe boolean"), "announced")
    probe = rows.where("probe").select("sig", "l", F.col("cid").alias("a"), F.col("size").alias("n"))
    index = rows.where("NOT probe").select("sig", "l", F.col("cid").alias("b"), F.col("size").alias("m"))
    met = probe.join(index, ["sig", "l"]).where((F.col("m") * den >= F.col("n") * num) & ((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))))
    met = met.select("a", "b").distinct()
    x = classes.select(F.col("cid").alias("a"), F.col("kind"), F.col("items").alias("x"))
    y = classes.select(F.col("cid").alias("b"), F.col("kind").alias("kind_b"), F.col("items").alias("y"))
    both = met.join(x, "a").join(y, "b").where("kind = kind_b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("kind", "a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return both.select("kind", "a", "b", "common", (F.col("total") - F.col("common")).alias("union")).where(F.col("common") * den >= F.col("union") * num)


def similar_sets(records: DataFrame, num: int = 6, den: int = 10, min_size: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pairs of classes, classes, members)`` for ``records(kind, key, terms array<string>)``.

    Jaccard similarity >= num / den > 0, compared in whole numbers, among sets of ``min_size`` members or more of the
    same kind. Null keys, null terms and repeats don't count; null and empty sets have no partner; copies of a key
    are united; an empty table gives empty tables; other columns are ignored.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must be in (0, 1]")
    classes, members = set_classes(records, max(1, min_size))
    return similar_classes(classes, num, den), classes, members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs ``(kind, key_a, key_b)``, key_a < key_b, of records: of similar classes, and of one class."""
    one = members.select(F.col("cid").alias("a"), F.col("key").alias("x"))
    two = members.select(F.col("cid").alias("b"), F.col("key").alias("y"))
    across = pairs.select("kind", "a", "b").join(one, "a").join(two, "b").select("kind", "x", "y")
    inside = members.select("kind", F.col("cid").alias("a"), F.col("key").alias("x")).join(two, F.col("a") == F.col("b")).where("x < y").select("kind", "x", "y")
    return across.unionByName(inside).select("kind", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
