"""Majority of repeated verdicts, recovered from free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VERDICT = "struct<overall:string,options:array<struct<option:string,verdict:string,evidence:string>>>"


def parsed(raw: Column) -> Column:
    """The JSON object from the first brace to the last; null (an abstention) where there is none."""
    text = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    v = F.from_json(F.when(text != "", text), VERDICT, {"mode": "PERMISSIVE"})
    good = F.get_json_object(text, "$").isNotNull()
    options = F.transform(F.coalesce(v["options"], F.from_json(F.lit("[]"), "array<struct<option:string,verdict:string,evidence:string>>")), lambda o: F.struct(F.coalesce(o["option"], F.lit("")).alias("option"), F.when(o["verdict"] == "evidenced", "evidenced").otherwise("unevidenced").alias("verdict"), F.coalesce(o["evidence"], F.lit("")).alias("evidence")))
    overall = F.when(v["overall"].isin("pass", "fail"), v["overall"]).when(F.exists(options, lambda o: o["verdict"] == "unevidenced"), "fail").otherwise("pass")
    return F.when(good, F.struct(overall.alias("overall"), options.alias("options")))


def majority(runs: DataFrame) -> DataFrame:
    """``runs(id, run, overall)`` (null overall: abstained) to ``(id, overall, runs, votes, agreement)``; the most frequent verdict, the
    one seen first on ties; abstentions leave the denominator; if all abstain the verdict is fail."""
    live = runs.where("overall IS NOT NULL").groupBy("id", "overall").agg(F.count(F.lit(1)).alias("votes"), F.min("run").alias("first_run"))
    best = live.groupBy("id").agg(F.max_by(F.struct("overall", "votes"), F.struct("votes", -F.col("first_run"))).alias("b"), F.sum("votes").alias("cast"))
    all_runs = runs.groupBy("id").agg(F.count(F.lit(1)).alias("runs"))
    out = all_runs.join(best, "id", "left")
    return out.select("id", F.coalesce("b.overall", F.lit("fail")).alias("overall"), "runs", F.coalesce("b.votes", F.lit(0)).alias("votes"), F.coalesce(F.col("b.votes") / F.col("cast"), F.lit(0.0)).alias("agreement"))


def judge(spark: SparkSession, options: list[str], evidence: str, runner: Callable[[str], str], runs: int = 3) -> dict:
    """Verdict on one list of options by an injected runner, with the options as the first run of the winning verdict judged them; without
    options there is nothing to judge and it passes."""
    if not options:
        return {"overall": "pass", "runs": 0, "agreement": 1.0, "options": []}
    prompt = "Which options does the evidence support? Answer in JSON: overall (pass or fail), options (option, verdict evidenced or unevidenced, evidence).\n\nOptions:\n" + "\n".join(f"- {o}" for o in options) + f"\n\nEvidence:\n{evidence}"
    raw = [(0, k, runner(prompt)) for k in range(max(1, runs))]
    df = spark.createDataFrame(raw, "id int, run int, raw string").select("id", "run", parsed(F.col("raw")).alias("v")).select("id", "run", "v.overall", "v.options")
    row = majority(df).first()
    said = df.where(F.col("overall") == row.overall).orderBy("run").first()
    return {"overall": row.overall, "runs": row.runs, "agreement": row.agreement, "options": [o.asDict() for o in said.options] if said else []}


def precision_recall(labelled: DataFrame) -> DataFrame:
    """``labelled(predicted boolean, actual boolean)`` to ``(tp, fp, fn, precision, recall, f1)``; 0 where a ratio has no denominator."""
    p, a = F.col("predicted"), F.col("actual")
    n = labelled.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
