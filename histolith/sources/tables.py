"""A history from parquet tables: copies of a commit or change that were ingested twice count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from histolith.functions import text as X
from histolith.model import History
from histolith.session import table


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row ingested last of each key (ties by its other values), in partitions by the first key that joins on it can use."""
    rest = [c for c in df.columns if c not in (*keys, "ingested_at")]
    best = df.repartition(keys[0]).groupBy(*keys).agg(F.max(F.struct("ingested_at", *rest)).alias("m"))
    return best.select(*keys, *[f"m.{c}" for c in rest])


def read_history(spark: SparkSession, d: str, lines: bool = False, brief: bool = False) -> History:
    """Tables ``commits``, ``changes`` and, if asked for, ``diff_lines`` of a folder. Changes of unknown commits are left out; paths are
    cleaned; the spelling of status is kept. ``brief``: bodies and old paths, the last to break ties, are neither read nor returned."""
    body, old = ([], []) if brief else (["body"], ["old_path"])
    commits = table(spark, d, "commits").where("sha IS NOT NULL")
    commits = _latest(commits.select("sha", "ingested_at", "repo", "log_pos", "author", "author_date", "parents", "subject", *body), ["sha"])
    commits = commits.select("repo", "sha", "log_pos", "author", F.col("author_date").alias("date"), "parents", F.coalesce("subject", F.lit("")).alias("subject"), *body)
    changes = table(spark, d, "changes").where("path IS NOT NULL").withColumn("path", X.clean_path(F.col("path")))
    changes = _latest(changes.select("sha", "path", "ingested_at", "ord", "status", *old), ["sha", "path"])
    of = commits.select("sha", "repo")
    changes = changes.join(of, "sha").select("repo", "sha", "ord", "status", "path", *[X.clean_path(F.col(c)).alias(c) for c in old])
    diff = None
    if lines:
        diff = table(spark, d, "diff_lines").where("path IS NOT NULL").withColumn("path", X.clean_path(F.col("path"))).distinct()
        diff = diff.join(of, "sha").select("repo", "sha", "path", "ord", "sign", "content")
    return History(commits, changes, diff)
