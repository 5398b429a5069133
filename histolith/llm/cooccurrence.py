"""Items that appear together: an incremental pair table.

The table lives in the shared folder as hash-bucketed parquet: pair counts, item counts and basket counts.
A change set of baskets becomes *signed deltas* (minus the pairs of the old content, plus those of the
new), is written once, reduced per key before and after one shuffle, and is added to the buckets it touches as one more run. The runs of
a bucket are merged when it is read, and rewritten as one when a change set touches a bucket of ``RUNS`` of them. Scores of a group change with its number of baskets, so after a merge those of the
touched groups are recomputed and the others kept (``refreshed``). A version counts once its manifest is written, so a lost executor
or a failed merge leaves the previous version in place; ``PairTable.open`` reads the last complete one.

Items enter the pair table as 64-bit hashes of ``(group, item)``; the item table keeps the strings. Every merge looks for
items that share a hash. All but one of them (the one already known) get a salted hash, which the manifest remembers, and the
merge is done again; so counts are exact, however many items there are.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from histolith.session import forget, new_folder, written

#: Key columns of the three tables.
KEYS = {"pairs": ["bucket", "a", "b"], "items": ["bucket", "grp", "item", "id"], "baskets": ["bucket", "grp"]}
SCHEMAS = {"pairs": "a long, b long, n long, bucket int", "items": "grp string, item string, id long, n long, bucket int", "baskets": "grp string, n long, bucket int"}
SCORES = "grp string, item_a string, item_b string, n_ab long, n_a long, n_b long, n long, lift double, npmi double"
SEED = 42
#: Pairs of the first change set that make one bucket more, and files that a bucket is written to at most.
PER_BUCKET, FILES = 1 << 26, 4
#: Runs of a bucket before it is rewritten.
RUNS = 4


def _pairs(ids: Column) -> Column:
    """All pairs ``(a, b)``, a < b, of a sorted array."""
    n = F.size(ids)
    firsts = F.transform(ids, lambda a, i: F.transform(F.slice(ids, i + 2, n), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(firsts)


def _total(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def _hash(salt: Column, grp: Column, item: Column) -> Column:
    return F.xxhash64(salt, grp, item)


class PairTable:
    """Persistent counts of pairs of items per group.

    ``PairTable(spark)`` starts an empty table in the shared folder (or under ``path``). The number of buckets follows from
    the first change set unless it is given.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None, max_items: int | None = None):
        self.spark, self.buckets, self.path, self.max_items = spark, buckets, path or new_folder(spark, "pairs"), max_items
        self.version = 0
        #: per table, the folders of each bucket's runs
        self.current: dict[str, dict[int, list[str]]] = {k: {} for k in KEYS}
        #: items whose hash is salted, for another one has it: (group, item, salt)
        self.salted: list[tuple[str, str, int]] = []
        #: groups whose counts the last merge changed
        self.touched: DataFrame | None = None

    # deltas -------------------------------------------------------------------------------------------

    def _id(self, grp: Column, item: Column) -> Column:
        salt = F.lit(SEED)
        for g, i, s in self.salted:
            salt = F.when((grp == g) & (item == i), F.lit(SEED + s)).otherwise(salt)
        return _hash(salt, grp, item)

    def _signed(self, baskets: DataFrame, sign: int) -> DataFrame:
        """(grp, items, n): the distinct non-null items of each basket; baskets over ``max_items`` (or
        without items) are left out, as in a full count."""
        items = F.array_distinct(F.filter("items", lambda i: i.isNotNull()))
        out = baskets.select(F.coalesce("grp", F.lit("")).alias("grp"), items.alias("items"), F.lit(sign).cast("long").alias("n")).where(F.size("items") > 0)
        return out.where(F.size("items") <= self.max_items) if self.max_items else out

    def _bucket(self, *keys: str) -> Column:
        return F.pmod(F.hash(*keys), F.lit(self.buckets)).alias("bucket")

    def _deltas(self, signed: DataFrame) -> dict[str, DataFrame]:
        """Reduced deltas of the three tables."""
        coded = signed.select("grp", F.transform("items", lambda i: F.struct(self._id(F.col("grp"), i).alias("id"), i.alias("item"))).alias("items"), "n")
        pairs = coded.where(F.size("items") > 1).select(F.explode(_pairs(F.array_sort(F.col("items.id")))).alias("p"), "n").select("p.a", "p.b", "n")
        items = coded.select("grp", F.explode("items").alias("i"), "n").select("grp", "i.item", "i.id", "n")
        return {
            "items": _total(items.select(self._bucket("id"), "grp", "item", "id", "n"), KEYS["items"]),
            "pairs": _total(pairs.select(self._bucket("a", "b"), "a", "b", "n"), KEYS["pairs"]),
            "baskets": _total(signed.select(self._bucket("grp"), "grp", "n"), KEYS["baskets"]),
        }

    # merge --------------------------------------------------------------------------------------------

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """Current rows, of some buckets only if they are given."""
        own = {b: f for b, f in self.current[name].items() if buckets is None or b in buckets}
        folders = sorted({f for runs in own.values() for f in runs})
        if not folders:
            return None
        part = lambda f: self.spark.read.schema(SCHEMAS[name]).option("basePath", f).parquet(f).where(F.col("bucket").isin([b for b, runs in own.items() if f in runs]))
        rows = reduce(DataFrame.unionByName, map(part, folders))
        return _total(rows, KEYS[name]) if any(len(runs) > 1 for runs in own.values()) else rows

    def _add(self, name: str, delta: DataFrame) -> None:
        """Add a run to the buckets that a delta touches; a bucket with many is rewritten as one."""
        folder, first = f"{self.path}/{name}/v{self.version}", not self.current[name]
        full = {b for b, runs in self.current[name].items() if len(runs) >= RUNS}
        if full:
            delta = written(delta, "delta")
            full &= {r.bucket for r in delta.select("bucket").distinct().collect()}  # numbers of buckets
            if full:
                delta = _total(delta.unionByName(self.read(name, full).select(delta.columns)), KEYS[name])
        if self.buckets > 1:  # few files a bucket
            delta = delta.repartition(F.col("bucket"), F.pmod(F.hash(*KEYS[name][1:]), F.lit(FILES)))
        delta.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        if first:
            touched = set(range(self.buckets))
        else:
            touched = full | {r.bucket for r in self.spark.read.schema(SCHEMAS[name]).parquet(folder).select("bucket").distinct().collect()}
        for b in touched:
            self.current[name][b] = [folder] if first or b in full else [*self.current[name].get(b, []), folder]

    def merge(self, new: DataFrame | None, old: DataFrame | None = None) -> None:
        """Add the deltas of the baskets ``(grp, items)`` that came and went as a new version."""
        signed = written(reduce(DataFrame.unionByName, [self._signed(df, s) for df, s in ((new, 1), (old, -1)) if df is not None]), "signed")
        if self.buckets is None:
            most = signed.agg(F.sum(F.size("items").cast("long") * (F.size("items") - 1) / 2)).first()[0] or 0
            self.buckets = max(1, math.ceil(most / PER_BUCKET))
        self.version += 1
        before = self.current
        known = self.read("items")
        while True:
            deltas = self._deltas(signed)
            self.current = {k: dict(v) for k, v in before.items()}
            self._add("items", deltas["items"])
            items = self.read("items")
            twice = items.groupBy("id").count().where("count > 1").select("id")
            clash = twice.limit(1).count() and items.join(twice, "id").collect()  # two in 2^64 share a hash: a handful of rows at most
            if not clash:
                break
            old_items = {(r.grp, r.item) for r in known.join(twice, "id").collect()} if known is not None else set()
            salts = {(g, i): s for g, i, s in self.salted}
            for i in {r.id for r in clash}:
                same = sorted((r for r in clash if r.id == i), key=lambda r: ((r.grp, r.item) not in old_items, r.grp, r.item))
                for n, r in enumerate(same[1:], 1):
                    salts[r.grp, r.item] = salts.get((r.grp, r.item), 0) + n
            self.salted = [(*k, s) for k, s in sorted(salts.items())]
        for name in ("pairs", "baskets"):
            self._add(name, deltas[name])
        self.touched = written(signed.select("grp").distinct(), "touched")
        forget(signed)
        state = json.dumps({"buckets": self.buckets, "max_items": self.max_items, "version": self.version, "current": self.current, "salted": self.salted})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v={self.version:09d}")

    def snapshot(self) -> PairTable:
        """The table as it is now, to read from after later merges."""
        t = PairTable(self.spark, self.buckets, self.path, self.max_items)
        t.version, t.salted, t.current = self.version, list(self.salted), {k: {b: list(f) for b, f in v.items()} for k, v in self.current.items()}
        return t

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PairTable:
        """The last complete version of the table under ``path``."""
        last = spark.read.text(f"{path}/manifest").orderBy(F.col("v").desc()).first()
        state = json.loads(last.value)
        t = cls(spark, state["buckets"], path, state["max_items"])
        t.version, t.current = state["version"], {k: {int(b): f for b, f in v.items()} for k, v in state["current"].items()}
        t.salted = [tuple(x) for x in state["salted"]]
        return t

    # scores -------------------------------------------------------------------------------------------

    def scores(self, min_joint: int = 1, min_lift: float = 0.0, affected: DataFrame | None = None) -> DataFrame:
        """``(grp, item_a, item_b, n_ab, n_a, n_b, n, lift, npmi)`` with item_a < item_b.

        lift = n_ab * n / (n_a * n_b), how much more often than chance. ``min_lift`` is compared in whole
        numbers where it is one. ``affected(grp)`` restricts the recomputation to groups that a merge
        touched. Pairs under ``min_joint`` are filtered before any join, and an item must itself reach
        ``min_joint``.
        """
        pairs, items, baskets = self.read("pairs"), self.read("items"), self.read("baskets")
        if pairs is None:
            return self.spark.createDataFrame([], SCORES)
        if affected is not None:
            items = items.join(affected.select("grp").distinct(), "grp", "left_semi")
        items = items.where(F.col("n") >= min_joint)
        pairs = pairs.where(F.col("n") >= min_joint).select("a", "b", F.col("n").alias("n_ab"))
        one = items.select(F.col("id").alias("a"), "grp", F.col("item").alias("x"), F.col("n").alias("n_x"))
        two = items.select(F.col("id").alias("b"), F.col("item").alias("y"), F.col("n").alias("n_y"))
        j = pairs.join(one, "a").join(two, "b").join(baskets.select("grp", "n"), "grp")
        swap = F.col("x") > F.col("y")
        j = j.select(
            "grp", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_ab",
            F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"), F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"), "n",
        )
        if min_lift:
            j = j.where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
        lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
        npmi = F.when(F.col("n_ab") == F.col("n"), F.lit(1.0)).otherwise(F.log(lift) / -F.log(F.col("n_ab") / F.col("n")))
        return j.withColumn("lift", lift).withColumn("npmi", npmi)

    def refreshed(self, scores: DataFrame, min_joint: int = 1, min_lift: float = 0.0) -> DataFrame:
        """``scores`` of before the last merge, with those of the groups it touched computed anew."""
        if self.touched is None:
            return scores
        return scores.join(self.touched, "grp", "left_anti").unionByName(self.scores(min_joint, min_lift, affected=self.touched))


def count_pairs(baskets: DataFrame, max_items: int | None = None, buckets: int | None = None) -> PairTable:
    """A pair table of ``baskets(grp, items array<string>)``, one row per basket.

    Null items and repeats in a basket don't count; null and empty arrays are no baskets; a null group is
    the group ``''``; other columns are ignored.
    """
    t = PairTable(baskets.sparkSession, buckets, max_items=max_items)
    t.merge(baskets)
    return t
