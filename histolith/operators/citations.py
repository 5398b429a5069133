"""Citations in written records, checked against the history by exact lookup; records are checked in one plan, not one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from histolith.functions import text as X
from histolith.session import written

CITATION = r"(?i)<!--\s*evidence:\s*([0-9a-fA-F]{7,40})\s+([a-z-]+):(.+?)\s*-->"
BULLET = r"(?md)^\s*[-*]\s+(.+?)\s*$"
NOTHING = r"(?i)no alternatives recorded|no verifiable evidence recorded"
TYPES = ("deleted", "added", "renamed", "message", "removed", "marker")
SECTIONS = {"madr": "Considered Options", "workaround": "Evidence"}
#: Characters of the runs on which marker texts meet lines.
GRAM = 8
ISSUE = r"https://github\.com/[\w.-]+/[\w.-]+/(?:issues|pull)/\d+"


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)


def record_type(text: Column) -> Column:
    t = F.lower(F.regexp_extract(front_matter(text), r"(?md)^type:\s*([\w-]+)\s*$", 1))
    return F.when(t.isin(*SECTIONS), t).otherwise("madr")


def record_status(text: Column) -> Column:
    s = F.lower(F.regexp_extract(front_matter(text), r"(?md)^status:\s*([\w-]+)\s*$", 1))
    return F.when(s == "", "active").otherwise(s)


def section(text: Column, name: str) -> Column:
    """Body of a ``##`` section up to the next one; empty where there is none."""
    return F.regexp_extract(text, rf"(?imsd)^##\s+{name}\s*$(.*?)(?=^##\s+|\z)", 1)


def linked_shas(text: Column) -> Column:
    """Lower-case commit ids of the ``Commits:`` line of the Links section; null where it names none."""
    line = F.regexp_extract(section(text, "Links"), r"(?id)[-*]\s+Commits?:\s*(.+?)(?:\n|\z)", 1)
    ids = F.transform(F.regexp_extract_all(line, F.lit("([0-9a-fA-F]{7,})"), F.lit(1)), F.lower)
    return F.when(F.size(ids) > 0, ids)


def issue_urls(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ISSUE})"), F.lit(1))))


def split_shas(spec: Column) -> Column:
    return F.filter(F.split(F.trim(spec), r"[,\s]+"), lambda s: s != "")


def options(text: Column) -> Column:
    """The bullets of the considered options, as they stand; none where the section says that nothing was recorded."""
    body = section(text, SECTIONS["madr"])
    return F.when(body.rlike(NOTHING), F.array().cast("array<string>")).otherwise(F.transform(F.regexp_extract_all(body, F.lit(BULLET), F.lit(1)), F.trim))


def citations(records: DataFrame) -> DataFrame:
    """``records(path, text)`` to one row per bullet of the section that can be verified: ``(path, ord, record_type, status, option, raw,
    sha, etype, detail, has_bullets_and_no_alt)``; sha is null for a bullet without citation. Where the section says that
    nothing was recorded, its bullets are not checked; the flag of the record says whether it had any."""
    t = F.col("text")
    r = records.where("text IS NOT NULL").select("path", "text", record_type(t).alias("record_type"), record_status(t).alias("status"), linked_shas(t).alias("linked"))
    body = F.when(F.col("record_type") == "workaround", section(t, SECTIONS["workaround"])).otherwise(section(t, SECTIONS["madr"]))
    r = r.withColumn("body", body).withColumn("bullets", F.regexp_extract_all("body", F.lit(BULLET), F.lit(1)))
    silent = F.col("body").rlike(NOTHING)
    r = r.withColumn("flag", silent & (F.size("bullets") > 0)).withColumn("bullets", F.when(silent, F.array().cast("array<string>")).otherwise(F.col("bullets")))
    b = r.select("path", "record_type", "status", "linked", "flag", F.posexplode("bullets").alias("ord", "raw"))
    got = lambda k: F.regexp_extract("raw", CITATION, k)
    detail = F.trim(got(3))
    quoted = detail.rlike(r"""^(".*"|'.*')$""") & (F.length(detail) >= 2)
    detail = F.when(quoted, F.substring(detail, F.lit(2), F.length(detail) - 2)).otherwise(detail)
    shown = F.trim(F.btrim(F.trim(F.regexp_replace("raw", CITATION, "")), F.lit("*_ ")))
    cited = got(1) != ""
    return b.select("path", "ord", "record_type", "status", "linked", F.col("flag").alias("has_bullets_and_no_alt"), shown.alias("option"), F.trim("raw").alias("raw"), F.when(cited, got(1)).alias("sha"), F.when(cited, F.lower(got(2))).alias("etype"), F.when(cited, detail).alias("detail"))


def verify(cited: DataFrame, commits: DataFrame, changes: DataFrame, diff_lines: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Status of every row of ``citations``: verified, failed, uncheckable or uncited, decided in the order scope, commit, type, evidence.

    ``allowed(path, shas array)`` is an explicit scope (an empty list allows nothing); a record without a row there is scoped by its
    own links, or unscoped if it has none. ``commits(sha, subject, body)``. A commit id that fits two commits is not found.
    """
    c = cited.withColumn("key", F.monotonically_increasing_id())
    if allowed is not None:
        c = c.join(allowed.select("path", F.transform("shas", F.lower).alias("given")), "path", "left").withColumn("scope", F.coalesce("given", "linked")).drop("given")
    else:
        c = c.withColumn("scope", F.col("linked"))
    c = written(c, "cited")
    inside = F.col("scope").isNull() | F.exists("scope", lambda s: X.sha_match(F.col("sha"), s))
    known = commits.select(F.col("sha").alias("full"), F.concat_ws("\n\n", "subject", "body").alias("message"))
    prefix = lambda x: F.substring(F.lower(x), 1, 7)
    # each read by three proofs and the result, so written once
    hit = c.where("sha IS NOT NULL").select("key", "sha", "etype", "detail").join(known.withColumn("p", prefix(F.col("full"))), F.col("p") == prefix(F.col("sha"))).where(F.startswith(F.lower("full"), F.lower("sha")))
    one = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("full"), F.min("etype").alias("etype"), F.min("detail").alias("detail"), F.min("message").alias("message")).where("n = 1").drop("n")
    one = written(one, "found")
    said = one.where(F.col("etype") == "message").where(F.contains(F.lower("message"), F.lower("detail"))).select("key")
    path = one.where(F.col("etype").isin("deleted", "added", "renamed")).join(changes.select(F.col("sha").alias("full"), F.upper(F.substring("status", 1, 1)).alias("letter"), F.col("path").alias("p"), "old_path"), "full")
    letter = F.create_map(*[F.lit(x) for x in ("deleted", "D", "added", "A", "renamed", "R")])
    moved = path.where((F.col("letter") == letter[F.col("etype")]) & ((F.col("p") == F.col("detail")) | (F.col("old_path") == F.col("detail")))).select("key")
    sign = F.when(F.col("etype") == "removed", "-").otherwise("+")
    lines = one.where(F.col("etype").isin("removed", "marker")).withColumn("sg", sign).join(diff_lines.select(F.col("sha").alias("full"), F.col("sign").alias("sg"), "content"), ["full", "sg"]).where(F.contains("content", F.col("detail"))).select("key")
    proof = said.unionByName(moved).unionByName(lines).distinct().withColumn("proof", F.lit(True))
    v = c.join(one.select("key", F.lit(True).alias("found")), "key", "left").join(proof, "key", "left")
    status = (
        F.when(F.col("sha").isNull(), "uncited").when(~inside, "failed").when(F.col("found").isNull(), "failed")
        .when(~F.col("etype").isin(*TYPES), "uncheckable").when(F.col("proof"), "verified").otherwise("failed")
    )
    reason = (
        F.when(F.col("sha").isNull(), "no inline evidence citation")
        .when(~inside, F.format_string("commit %s not part of this candidate (see Links)", "sha"))
        .when(F.col("found").isNull(), F.format_string("commit %s not found", "sha"))
        .when(~F.col("etype").isin(*TYPES), F.format_string("'%s' is not a verifiable evidence type", "etype"))
        .when(F.col("proof"), F.format_string("%s: %s found in %s", "etype", "detail", "sha"))
        .otherwise(F.format_string("%s: %s not found in %s", "etype", "detail", "sha"))
    )
    return v.select("path", "ord", "record_type", "option", "raw", "sha", "etype", "detail", F.col("scope").isNotNull().alias("scoped"), status.alias("status"), reason.alias("reason"))


def verdicts(records: DataFrame, verified: DataFrame) -> DataFrame:
    """Per record ``(path, record_type, kept, dropped, overall, rewritten)``; a record without bullets passes."""
    ok = F.col("status") == "verified"
    per = verified.groupBy("path").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))
    out = records.where("text IS NOT NULL").select("path", record_type(F.col("text")).alias("record_type")).join(per, "path", "left").fillna(0, ["kept", "dropped"])
    clean = F.col("dropped") == 0
    return out.select("path", "record_type", "kept", "dropped", F.when(clean, "pass").otherwise("fail").alias("overall"), F.when(clean, "pass").otherwise("rewritten").alias("rewritten"))


def contained(details: DataFrame, lines: DataFrame) -> DataFrame:
    """``details(detail)``: the distinct texts that stand in some line of ``lines(line)``.

    A line that holds a text holds each of its runs of ``GRAM`` characters, so texts meet lines on one run, the one that the fewest lines
    hold, before the text itself is searched. Texts that are shorter than a run are searched in every line.
    """
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda k: F.substring(c, k, F.lit(GRAM)))
    details = written(details.where("detail IS NOT NULL").distinct(), "details")
    lines = written(lines.where("line IS NOT NULL").distinct(), "lines")
    keyed = details.where(F.length("detail") >= GRAM).select("detail", F.explode(F.array_distinct(grams(F.col("detail")))).alias("gram"))
    held = lines.where(F.length("line") >= GRAM).select("line", F.explode(F.array_distinct(grams(F.col("line")))).alias("gram"))
    count = held.join(keyed.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a run that no line holds isn't counted, and its text is in no line
    rare = keyed.join(count, "gram", "left").groupBy("detail").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    far = rare.join(held, "gram").where(F.contains("line", "detail")).select("detail")
    near = details.where(F.length("detail") < GRAM).join(lines, F.contains("line", "detail")).select("detail")
    return far.unionByName(near).distinct()


def lifecycle(records: DataFrame, worktree: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Findings on workaround records: ``(path, status, findings)``.

    ``worktree(path, line)``; markdown is left out, as a record quotes its own marker. Only active records are checked.
    ``closed(url)``: issues known to be closed. Markers are literal texts searched in all lines by ``contained``.
    """
    r = records.where("text IS NOT NULL").withColumn("record_type", record_type(F.col("text"))).where("record_type = 'workaround'")
    base = r.select("path", record_status(F.col("text")).alias("status"), issue_urls(F.col("text")).alias("urls"))
    active = base.where("status = 'active'")
    marks = citations(r.select("path", "text")).where("etype = 'marker'").select("path", "ord", "detail").join(active.select("path"), "path", "left_semi")
    there = contained(marks.select("detail"), worktree.where("NOT lower(path) LIKE '%.md'").select("line"))
    gone = marks.join(there, "detail", "left_anti")
    text = F.concat(F.lit('marker line not found in working tree: "'), "detail", F.lit('" — workaround possibly removed; update status'))
    rows = gone.select("path", F.struct(F.lit(1).alias("k"), "ord", text.alias("t")).alias("f"))
    none = F.lit("no marker citations to track — removal cannot be detected automatically")
    rows = rows.unionByName(active.join(marks.select("path"), "path", "left_anti").select("path", F.struct(F.lit(0).alias("k"), F.lit(0).alias("ord"), none.alias("t")).alias("f")))
    if closed is not None:
        url = F.concat(F.lit("upstream issue closed: "), "url", F.lit(" — removal condition may be met"))
        rows = rows.unionByName(active.select("path", F.posexplode("urls").alias("ord", "url")).join(closed, "url", "left_semi").select("path", F.struct(F.lit(2).alias("k"), "ord", url.alias("t")).alias("f")))
    found = rows.groupBy("path").agg(F.array_sort(F.collect_list("f")).alias("f")).select("path", F.col("f.t").alias("findings"))
    return base.join(found, "path", "left").select("path", "status", F.coalesce("findings", F.array().cast("array<string>")).alias("findings"))


def evidence_blocks(shas: DataFrame, commits: DataFrame, changes: DataFrame, patch: DataFrame | None = None, max_files: int = 40, max_lines: int = 200) -> DataFrame:
    """``shas(sha)`` to ``(sha, block)``: subject, changed files and (with ``patch``) changed lines of each commit, capped with a note of
    how many more there are."""

    def cap(rows: DataFrame, text: Column, order: list[str], most: int, more: str, name: str) -> DataFrame:
        # only the first `most` rows of a commit are gathered; all are counted
        from histolith.operators.numbering import numbered

        n = numbered(rows.select("sha", text.alias("_t"), *order), ["sha"], order, "_n")
        g = n.groupBy("sha").agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "_t")))).alias("x"), F.max("_n").alias("_all"))
        tail = F.when(F.col("_all") > most, F.array(F.format_string(f"  ... (%d {more})", F.col("_all") - most))).otherwise(F.array().cast("array<string>"))
        return g.select("sha", F.concat(F.col("x._t"), tail).alias(name))

    own = shas.select("sha").distinct()
    heads = own.join(commits.select("sha", "subject"), "sha")
    files = changes.join(own, "sha", "left_semi")
    out = heads.join(cap(files, F.concat(F.lit("  "), F.concat_ws("\t", "status", "old_path", "path")), ["ord", "path"], max_files, "more files", "f"), "sha", "left")
    parts = [F.array(F.concat_ws(" ", F.lit("commit"), "sha", "subject")), F.coalesce("f", F.array().cast("array<string>"))]
    if patch is not None:
        lines = cap(patch.join(own, "sha", "left_semi"), F.concat(F.lit("  "), "sign", F.coalesce("content", F.lit(""))), ["path", "ord"], max_lines, "more diff lines", "p")
        out = out.join(lines, "sha", "left")
        parts.append(F.when(F.col("p").isNotNull(), F.concat(F.array(F.lit("  --- diff ---")), "p")).otherwise(F.array().cast("array<string>")))
    return out.select("sha", F.array_join(F.concat(*parts), "\n").alias("block"))
