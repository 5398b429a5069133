"""Per-key results where a few keys hold most records.

The rows are range-partitioned on the *composite* (key, order...), with quantiles sampled by Spark, so that a heavy
key is cut into as many partitions as its share of the rows asks for. Each task reads its sorted range once and keeps
one partial state per key (count, first, last); all keys but the first and last of a range are complete, and
the partial states of the boundary keys are stitched by one small aggregation, of at most one row per key and
range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, at, id) of a range to states, one per key and batch; rows with the same key, at and id
    count once."""
    last = None  # last row of the batch before
    for batch in batches:
        if not batch.num_rows:
            continue
        key, at, ident = batch.column("key"), batch.column("at"), batch.column("id")
        n = batch.num_rows

        def changes(a: pa.Array) -> np.ndarray:
            if n == 1:
                return np.zeros(0, bool)
            same = pc.equal(a.slice(1), a.slice(0, n - 1))
            both_null = pc.and_(pc.is_null(a.slice(1)), pc.is_null(a.slice(0, n - 1)))
            return ~np.array(pc.if_else(both_null, True, pc.fill_null(same, False)))

        new_key = changes(key)
        new_row = new_key | changes(at) | changes(ident)
        head = (key[0].as_py(), at[0].as_py(), ident[0].as_py())
        first_new = head != last
        last = (key[n - 1].as_py(), at[n - 1].as_py(), ident[n - 1].as_py())
        fresh = np.r_[first_new, new_row].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, new_key])
        ends = np.r_[starts[1:], n] - 1
        counts = np.add.reduceat(fresh, starts)
        # rows without `at` sort first: the first dated row of a run follows them
        dated = ~np.array(pc.is_null(at))
        undated = np.add.reduceat((~dated).astype(np.int64), starts)
        first = np.minimum(starts + undated, ends)
        has = dated[ends]
        where = pa.array(has)
        firsts, lasts = pa.array(first), pa.array(ends)
        null = lambda a: pc.if_else(where, a, pa.scalar(None, a.type))
        yield pa.RecordBatch.from_arrays(
            [key.take(pa.array(starts)), pa.array(counts), null(at.take(firsts)), null(ident.take(firsts)), null(at.take(lasts)), null(ident.take(lasts))],
            names=["key", "n", "first_at", "first_id", "last_at", "last_id"],
        )


def first_last_per_key(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """``rows(key, at, id)`` to ``(key, n, first_at, first_id, last_at, last_id)`` per key.

    n = distinct (at, id); first and last by (at, id), rows with a null ``at`` left out of these but counted. A
    null key is a key; a null id sorts first; a key with null ``at`` only has null firsts and lasts. An empty table gives no
    rows; other columns are ignored. ``ranges``: partitions to cut into, Spark's shuffle partitions if unset.
    """
    rows = rows.select("key", "at", "id")
    order = ["key", "at", "id"]
    cut = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    kinds = dict(rows.dtypes)
    out = f"key {kinds['key']}, n long, first_at {kinds['at']}, first_id {kinds['id']}, last_at {kinds['at']}, last_id {kinds['id']}"
    states = cut.sortWithinPartitions(*order).mapInArrow(_states, out)
    first = F.min(F.when(F.col("first_at").isNotNull(), F.struct("first_at", "first_id")))
    last = F.max(F.when(F.col("last_at").isNotNull(), F.struct("last_at", "last_id")))
    stitched = states.groupBy("key").agg(F.sum("n").alias("n"), first.alias("f"), last.alias("l"))
    return stitched.select("key", "n", "f.first_at", "f.first_id", F.col("l.last_at").alias("last_at"), F.col("l.last_id").alias("last_id"))
