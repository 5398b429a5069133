"""Frequency of every distinct value: global integer dictionary, blockwise count arrays, range sums.

1. *Dictionary*: the distinct ``(kind, term)`` get integers. A partition of the dictionary numbers its
   terms in a row, ``partition << 33 | position``, so ranges of integers are dense.
2. *Encode*: every task reduces the records of an Arrow batch to ``(term, occurrences, records)`` with
   C++ dictionary encoding, and the batches of a task are combined before the shuffle, so that a term which fills a third of
   all rows leaves a task as one row; the reduced rows are then joined with the dictionary.
3. *Blocks*: encoded counts are accumulated into count arrays, one per block of ``BLOCK`` integers.
4. *Sum by range*: the arrays of a block are added; a position of the sum is the count of one term.

Nothing is collected; the largest object of a task is one array of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from histolith.session import written

#: Integers of the dictionary that share one count array.
BLOCK = 4096


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (kind, terms) to (kind, term, occurrences, records), per batch."""
    for batch in batches:
        kinds, terms = batch.column("kind"), batch.column("terms")
        for kind in pc.unique(kinds).to_pylist():
            rows = terms.filter(pc.equal(kinds, kind))
            values = pc.list_flatten(rows).dictionary_encode()
            if not len(values):
                continue
            ids, parents = values.indices.to_numpy(), pc.list_parent_indices(rows).to_numpy()
            n = len(values.dictionary)
            pairs = np.unique(parents.astype(np.int64) * n + ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.string()), values.dictionary, pa.array(np.bincount(ids, minlength=n).astype(np.int64)), pa.array(np.bincount(pairs % n, minlength=n).astype(np.int64))],
                names=["kind", "term", "occurrences", "records"],
            )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded counts (id, occurrences, records) to sparse count arrays per block."""
    for batch in batches:
        ids = batch.column("id").to_numpy()
        if not len(ids):
            continue
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        distinct, first = np.unique(ids, return_index=True)
        sums = [np.add.reduceat(batch.column(c).to_numpy()[order], first) for c in ("occurrences", "records")]
        block = distinct // BLOCK
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        offsets = pa.array(np.r_[starts, len(distinct)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((distinct % BLOCK).astype(np.int32), *sums)]
        yield pa.RecordBatch.from_arrays([pa.array(block[starts]), *lists], names=["block", "at", "occurrences", "records"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of whole blocks, sorted by block, to one row per integer."""

    def out(block: int, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts[1])
        return pa.RecordBatch.from_arrays([pa.array(block * BLOCK + at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["id", "occurrences", "records"])

    now, counts = None, np.zeros((2, BLOCK), np.int64)
    for batch in batches:
        at, lengths = batch.column("at"), pc.list_value_length(batch.column("at")).to_numpy()
        ends = np.cumsum(lengths)
        at, occ, rec = (pc.list_flatten(batch.column(c)).to_numpy() for c in ("at", "occurrences", "records"))
        for block, lo, hi in zip(batch.column("block").to_pylist(), ends - lengths, ends):
            if block != now:
                if now is not None:
                    yield out(now, counts)
                now, counts = block, np.zeros((2, BLOCK), np.int64)
            np.add.at(counts[0], at[lo:hi], occ[lo:hi])
            np.add.at(counts[1], at[lo:hi], rec[lo:hi])
    if now is not None:
        yield out(now, counts)


def term_frequencies(records: DataFrame) -> DataFrame:
    """Occurrences and records of every term.

    ``records(kind, key, terms array<string>)``: a key may come in several copies; the copies of a key
    count once (the longest list of terms, ties by its values). Other columns are ignored. Null terms,
    null arrays and empty arrays hold no term but their record counts in ``total``; a null key is a record
    of its own; an empty table gives no row. Gives ``(kind, term, occurrences, records, total)`` with
    ``total`` = records of the kind; repeats of a term in a record count in ``occurrences`` only.
    """
    once = records.groupBy("kind", "key").agg(F.max(F.struct(F.size("terms").alias("n"), F.col("terms"))).alias("m"))
    once = written(once.select("kind", F.coalesce(F.col("m.terms"), F.array().cast("array<string>")).alias("terms")), "records")
    totals = once.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    reduced = once.where(F.size("terms") > 0).select("kind", F.filter("terms", lambda t: t.isNotNull()).alias("terms")).mapInArrow(_reduce, "kind string, term string, occurrences long, records long")
    # combined in the task before the shuffle, which is that of the join as well
    reduced = reduced.groupBy("kind", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    dictionary = written(once.select("kind", F.explode("terms").alias("term")).where("term IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    encoded = reduced.join(dictionary, ["kind", "term"]).select("id", "occurrences", "records")
    blocks = encoded.mapInArrow(_blocks, "block long, at array<int>, occurrences array<long>, records array<long>")
    sums = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "id long, occurrences long, records long")
    return sums.join(dictionary, "id").join(totals, "kind").select("kind", "term", "occurrences", "records", "total")


def marks(frequencies: DataFrame, common_above: int = 3, common_share: int = 50) -> DataFrame:
    """``mark``: ``rare`` for one record, ``common`` for more than ``common_above`` records and more than
    one in ``common_share`` of all, else null."""
    n, total = F.col("records"), F.col("total")
    return frequencies.withColumn("mark", F.when(n == 1, "rare").when((n > common_above) & (n * common_share > total), "common"))
