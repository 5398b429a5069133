"""The pN_ queries of this package, over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from histolith.functions import text as X
from histolith.llm import records as R
from histolith.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


# 1 ----------------------------------------------------------------------------------------------------


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.frequency import marks, term_frequencies

    rows = reduce(DataFrame.unionByName, (f(spark, d) for f in (R.commit_files, R.candidate_tokens, R.candidate_dirs)))
    return marks(term_frequencies(rows))


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("mark IS NOT NULL").select("kind", "term", "mark")


# 2 ----------------------------------------------------------------------------------------------------


#: Share of the commits, by time of ingestion, of the first change set.
FIRST = 0.9


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    """(grp, first, late, items): paths of each commit as known from the first rows that were ingested (null: not yet known), whether rows came
    late, and as known from all rows. Of the copies of a commit the one with the most paths counts."""
    c = table(spark, d, "commits")
    cut = c.agg(F.percentile_approx(F.unix_micros(F.col("ingested_at").cast("timestamp")), FIRST, 1000)).first()[0] or 0
    late = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")) > F.lit(cut), F.lit(False))
    c = c.select("repo", "sha", late.alias("late"), X.clean_paths(F.col("files")).alias("items"))
    own = F.struct(F.size("items"), F.col("items"))
    c = c.groupBy("repo", "sha").agg(F.max(F.when(~F.col("late"), own)).alias("first"), F.max("late").alias("late"), F.max(own).alias("m"))
    return c.select(F.col("repo").alias("grp"), F.col("first.items").alias("first"), "late", F.col("m.items").alias("items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Two merges: the first ingestions, then the late ones, which also take the first content of their commits back."""
    from histolith.llm.cooccurrence import count_pairs

    known = written(_baskets(spark, d), "baskets")
    t = count_pairs(known.where("first IS NOT NULL").select("grp", F.col("first").alias("items")), max_items=30)
    first = t.snapshot()
    late = known.where("late")
    t.merge(late.select("grp", "items"), late.where("first IS NOT NULL").select("grp", F.col("first").alias("items")))
    # groups that the second merge doesn't touch keep their first scores
    same = known.select(F.coalesce("grp", F.lit("")).alias("grp")).distinct().join(t.touched, "grp", "left_anti")
    scores = first.scores(min_joint=5, min_lift=3, affected=same).unionByName(t.scores(min_joint=5, min_lift=3, affected=t.touched))
    return scores.select(F.col("grp").alias("repo"), F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


# 3 ----------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.distinctive import distinctive_terms

    tokens = R.candidate_tokens(spark, d).withColumn("kind", F.lit("candidate"))
    return distinctive_terms(R.commit_words(spark, d).unionByName(tokens))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select("kind", F.col("key").alias("record_key"), "term", "tf", "df", F.round("score", 9).alias("score"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.distinctive import most_distinctive

    return most_distinctive(_scored(spark, d)).select("kind", F.col("key").alias("record_key"), "term")


# 4 ----------------------------------------------------------------------------------------------------


def _sets(spark: SparkSession, d: str) -> DataFrame:
    files = R.commit_files(spark, d).withColumn("kind", F.lit("commit"))
    return files.unionByName(R.candidate_tokens(spark, d).withColumn("kind", F.lit("candidate")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.setjoin import expanded, similar_sets

    pairs, _, members = similar_sets(_sets(spark, d), 6, 10, min_size=4)
    return expanded(pairs, members)


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with a partner: its class and the number of its partners, copies not expanded."""
    from histolith.llm.setjoin import similar_sets

    pairs, classes, members = similar_sets(_sets(spark, d), 6, 10, min_size=4)
    sizes = classes.select("cid", "kind", "rep", "copies")
    ends = pairs.select(F.col("a").alias("cid"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("o")))
    across = ends.join(sizes.select(F.col("cid").alias("o"), "copies"), "o").groupBy("cid").agg(F.sum("copies").alias("across"))
    own = sizes.join(across, "cid", "left").withColumn("links", F.coalesce("across", F.lit(0)) + F.col("copies") - 1).where("links > 0")
    return members.select("cid", "key").join(own, "cid").select("kind", F.col("key").alias("record_key"), F.col("rep").alias("class_key"), "links")


# 5 ----------------------------------------------------------------------------------------------------


def _candidate_commits(spark: SparkSession, d: str) -> DataFrame:
    """(cand_id, sha): full shas that a candidate names; ids of eight digits or more, any case and blanks."""
    named = table(spark, d, "candidates").where("cand_id IS NOT NULL").select("cand_id", F.explode("commits").alias("u")).where("u IS NOT NULL")
    named = named.select("cand_id", F.lower(F.trim("u")).alias("u")).where("length(u) >= 8").distinct()
    shas = table(spark, d, "commits").where("sha IS NOT NULL").select("sha").distinct()
    head = lambda c: F.substring(F.col(c), 1, 8).alias("head")
    hit = named.select("cand_id", "u", head("u")).join(shas.select("sha", F.substring(F.lower("sha"), 1, 8).alias("head")), "head")
    return hit.where(F.startswith(F.lower("sha"), F.col("u"))).select("cand_id", "sha").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.groups import connected_groups

    named = written(_candidate_commits(spark, d), "named")
    hub = named.groupBy("cand_id").agg(F.min("sha").alias("a"))
    edges = named.join(hub, "cand_id").where("sha <> a").select("a", F.col("sha").alias("b"))
    return connected_groups(edges).select(F.col("id").alias("sha"), F.col("grp").alias("group_sha"))


# 7 ----------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str, candidates: bool) -> DataFrame:
    """(repo, path, seen, flags): paths of changes, what diff lines say of them, and paths of candidates."""
    from histolith.llm.authored import FLAGS, line_flags

    no = {f: F.lit(False) for f in FLAGS}
    pick = lambda df, seen, flags: df.select("sha", X.clean_path(F.col("path")).alias("path"), F.lit(seen).alias("seen"), *[c.alias(k) for k, c in flags.items()])
    lines = table(spark, d, "diff_lines").where("path IS NOT NULL AND content IS NOT NULL")
    said = pick(lines, False, line_flags(F.col("content"))).where(" OR ".join(FLAGS))
    rows = pick(table(spark, d, "changes").where("path IS NOT NULL"), True, no).unionByName(said)
    repos = table(spark, d, "commits").where("sha IS NOT NULL").groupBy("sha").agg(F.min("repo").alias("repo"))
    rows = rows.join(repos, "sha").drop("sha")
    if candidates:
        c = table(spark, d, "candidates").select("repo", F.explode(X.clean_paths(F.col("files"))).alias("path")).distinct()
        rows = rows.unionByName(c.select("repo", "path", F.lit(True).alias("seen"), *[v.alias(k) for k, v in no.items()]))
    rows = rows.groupBy("repo", "path").agg(*[F.max(x).alias(x) for x in ("seen", *FLAGS)])
    return rows.where("seen")


def p7_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every path of changes and of candidates with its label."""
    from histolith.llm.authored import label_files

    return label_files(_files(spark, d, candidates=True))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.authored import label_files

    return label_files(_files(spark, d, candidates=False)).where("label <> 'hand'").select("repo", "path")


# 8 ----------------------------------------------------------------------------------------------------


def p8_carried(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.leakage import leaked

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "text")
    return leaked(docs, items).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "carried")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_carried(spark, d).select("doc_id", "item_id")


# 9 ----------------------------------------------------------------------------------------------------


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    from histolith.llm.mixture import canonical_source, fit_mixture, token_lengths

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), canonical_source(F.col("source")).alias("source"), "text")
    sized = written(token_lengths(docs), "lengths")
    targets = table(spark, d, "mix_targets")
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).first().total
    return sized, targets, written(fit_mixture(sized, targets, total), "plan"), total


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.mixture import shares

    _, targets, plan, total = _mixture(spark, d)
    return shares(plan, targets, total)


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.mixture import select_documents

    sized, _, plan, _ = _mixture(spark, d)
    return select_documents(sized, plan).where("times > 0").select(F.col("id").alias("doc_id"), "source", "tokens", "times")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).where("short").select("source")


# 10 ---------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text")


def p10_outliers(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.repetition import measured, outliers

    return outliers(measured(_texts(spark, d))).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from histolith.llm.repetition import self_repeating

    return self_repeating(_texts(spark, d)).select(F.col("id").alias("doc_id"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}
