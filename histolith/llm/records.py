"""The set-valued records of a data folder, in the one shape that the operators here take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from histolith.functions import text as X
from histolith.session import table


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits")
    return c.select(F.lit("file").alias("kind"), F.col("sha").alias("key"), X.clean_paths(F.col("files")).alias("terms"))


def candidate_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    return c.select(F.lit("token").alias("kind"), F.col("cand_id").alias("key"), X.clean_tokens(F.col("topic_tokens")).alias("terms"))


def candidate_dirs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    return c.select(F.lit("dir").alias("kind"), F.col("cand_id").alias("key"), X.present(F.col("top_dirs")).alias("terms"))


def commit_words(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits")
    return c.select(F.lit("commit").alias("kind"), F.col("sha").alias("key"), X.subject_words(F.col("subject")).alias("terms"))
