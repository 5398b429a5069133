"""Verified records as text: bullets that hold are kept verbatim, provenance is stamped into the front matter, idempotently.

All of it is column expressions on whole texts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from histolith.operators.citations import SECTIONS, front_matter

EMPTY = {"madr": "No alternatives recorded in commit history.", "workaround": "No verifiable evidence recorded."}
FRONT = r"(?s)\A---\n.*?\n---"
#: The own key of the front matter with the indented and empty lines below it.
OWN_BLOCK = r"(?md)^generation:.*\n(?:[ \t].*\n|\n)*"


def stamped(text: Column, block: Column) -> Column:
    """``text`` with the front matter's own block replaced by ``block``; a text without front matter gets one."""
    others = F.btrim(F.regexp_replace(F.concat(front_matter(text), F.lit("\n")), OWN_BLOCK, ""), F.lit(" \t\r\n"))
    new = F.concat(F.lit("---\n"), F.when(others != "", F.concat(others, F.lit("\n"))).otherwise(""), block, F.lit("\n---"))
    return F.when(text.rlike(FRONT), F.concat(new, F.regexp_replace(text, FRONT, ""))).otherwise(F.concat(new, F.lit("\n\n"), text))


def with_bullets(text: Column, name: str, body: Column) -> Column:
    """``text`` with another body of the section ``name``, if it has that section."""
    pattern = rf"(?imsd)\A(.*?^##\s+{name}\s*?$)(.*?)(^##\s+.*)?\z"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.concat(part(1), F.lit("\n\n"), body, F.lit("\n\n"), part(3))).otherwise(text)


def render(records: DataFrame, verified: DataFrame, scoped: DataFrame, method: str = "histolith/v1", date: str | None = None) -> DataFrame:
    """``records(path, text)`` and the rows of ``verify`` to ``(path, text)``; a record without bullets keeps its body.
    ``scoped(path, record_type, scoped)``."""
    ok = F.col("status") == "verified"
    per = verified.groupBy("path").agg(F.array_sort(F.collect_list(F.when(ok, F.struct("ord", "raw")))).alias("k"), F.count_if(~ok).alias("dropped"))
    x = records.join(scoped, "path").join(per, "path", "left")
    x = x.select("path", "text", "record_type", "scoped", F.coalesce("k.raw", F.array().cast("array<string>")).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))
    bullets = F.when(F.size("kept") > 0, F.array_join(F.transform("kept", lambda k: F.concat(F.lit("- "), k)), "\n"))
    body = lambda kind: F.rtrim(F.coalesce(bullets, F.lit(EMPTY[kind])))
    swapped = F.when(F.col("record_type") == "workaround", with_bullets(F.col("text"), SECTIONS["workaround"], body("workaround"))).otherwise(with_bullets(F.col("text"), SECTIONS["madr"], body("madr")))
    x = x.withColumn("text", F.when(F.size("kept") + F.col("dropped") > 0, swapped).otherwise(F.col("text")))
    facts = {
        "method": F.lit(method), "generated": F.lit(date or datetime.date.today().isoformat()), "evidence-verified": F.lit("true"),
        "verification": F.when(F.col("scoped"), "citation-structural").otherwise("citation-structural-unscoped"),
        "options-kept": F.size("kept").cast("string"), "options-dropped": F.col("dropped").cast("string"),
    }
    block = F.concat_ws("\n", F.lit("generation:"), *[F.concat(F.lit(f"  {k}: "), v) for k, v in facts.items()])
    return x.select("path", F.regexp_replace(stamped(F.col("text"), block), "\n{3,}", "\n\n").alias("text"))
