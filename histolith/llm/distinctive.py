"""How distinctive a term is per record: term frequency times smoothed logarithmic inverse document
frequency, length-normalised.

``score = tf / length * (ln((1 + N) / (1 + df)) + 1)`` with tf = times of the term in the record, length =
terms of the record, df = records holding the term, N = all records of the kind.

Document frequencies come from the distinct term-record rows by one reduced shuffle. Joining them back would
send all rows of an everyday word to one task, so words held by more than one in ``HEAVY`` term-record rows
are joined by broadcast (there can be at most ``HEAVY`` such words, a proven bound) and only the others by
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from histolith.session import written

#: At most so many words are broadcast.
HEAVY = 2000


def distinctive_terms(records: DataFrame) -> DataFrame:
    """Score of every distinct term of every record.

    ``records(kind, key, terms array<string>)``; copies of a key count once (the longest list, ties by its
    values). Null terms don't count, records without terms give no row but count in N, a null key is a record of its
    own. Gives ``(kind, key, term, tf, length, df, n, score)``.
    """
    terms = F.filter("terms", lambda t: t.isNotNull())
    once = records.select("kind", "key", F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))
    once = once.groupBy("kind", "key").agg(F.max(F.struct(F.size("terms").alias("n"), F.col("terms"))).alias("m"))
    once = written(once.select("kind", "key", "m.terms"), "terms")
    totals = once.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    rows = once.select("kind", "key", F.size("terms").alias("length"), "terms", F.explode(F.array_distinct("terms")).alias("term"))
    tf = F.size("terms") - F.size(F.array_remove(F.col("terms"), F.col("term")))
    rows = rows.select("kind", "key", "term", "length", tf.alias("tf"))
    df = written(rows.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df")), "df")
    all_rows = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("s")).first().s
    heavy = df.where(F.col("df") * HEAVY > all_rows)
    light = df.where(F.col("df") * HEAVY <= all_rows)
    rows = rows.join(F.broadcast(heavy), ["kind", "term"], "left")
    known = rows.where("df IS NOT NULL")
    rest = rows.where("df IS NULL").drop("df").join(light, ["kind", "term"])
    out = known.unionByName(rest).join(F.broadcast(totals), "kind")
    score = F.col("tf") / F.col("length") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    return out.select("kind", "key", "term", "tf", "length", "df", "n", score.alias("score"))


def most_distinctive(scored: DataFrame, min_df: int = 2, max_df: int = 5) -> DataFrame:
    """Per record the term held by the fewest records, the smallest on ties, among terms that at least
    ``min_df`` records hold; only where at most ``max_df`` hold it."""
    # a record with any term of min_df <= df <= max_df has its minimum among these
    few = scored.where(F.col("df").between(min_df, max_df))
    return few.groupBy("kind", "key").agg(F.min(F.struct("df", "term")).alias("m")).select("kind", "key", "m.term", "m.df")
