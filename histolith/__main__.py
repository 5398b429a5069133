"""Command line: ``python -m histolith analyze|verify|judge-options|check-workarounds|check-tags|evidence ...``."""

from __future__ import annotations

import argparse
import json
import shlex
import subprocess
import sys

from pyspark.sql import SparkSession, functions as F

from histolith.model import Config
from histolith.operators import citations, render, tags, votes
from histolith.plans import pipeline
from histolith.session import written
from histolith.sources import gitlog


UNSCOPED = "warning: no candidate commit set (no --commits and no Links/Commits line); citations verified unscoped"


def _records(spark: SparkSession, paths: list[str]):
    rows = []
    for p in paths:
        with open(p) as f:
            rows.append((p, f.read()))
    return spark.createDataFrame(rows, "path string, text string")


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    records = _records(spark, a.records)
    h = gitlog.read_history(spark, {"repo": a.repo})
    allowed = None
    if a.commits is not None:
        allowed = records.select("path", citations.split_shas(F.lit(a.commits)).alias("shas"))
    cited = citations.citations(records)
    v = written(citations.verify(cited, h.commits, h.changes, h.diff_lines, allowed), "verified")
    out = citations.verdicts(records, v).orderBy("path").collect()
    details = v.orderBy("path", "ord").collect()
    scope = F.lit(True) if allowed is not None else citations.linked_shas(F.col("text")).isNotNull()
    kind = records.select("path", citations.record_type(F.col("text")).alias("record_type"), scope.alias("scoped"))
    scoped = {r.path: r.scoped for r in kind.collect()}  # records named on the command line
    for r in out:
        if not scoped[r.path]:
            print(f"{UNSCOPED}: {r.path}", file=sys.stderr)
    if a.json:
        of = lambda p: [{k: r[k] for k in ("option", "sha", "etype", "detail", "status", "reason")} for r in details if r.path == p]
        found = [{"path": r.path, "overall": r.rewritten if a.rewrite else r.overall, "kept": r.kept, "dropped": r.dropped, "scoped": scoped[r.path], "verdicts": of(r.path)} for r in out]
        print(json.dumps(found, indent=2))
    else:
        for r in out:
            print(f"overall: {r.rewritten if a.rewrite else r.overall}  kept: {r.kept}  dropped: {r.dropped}  {r.path}")
        for r in details:
            print(f"  [{r.status:11}] {r.option}  — {r.reason}")
    if a.rewrite:
        for r in render.render(records, v, kind).collect():
            if a.write:
                with open(r.path, "w") as f:
                    f.write(r.text)
            elif not a.json:
                print(r.text)
        return 0
    return int(any(r.overall != "pass" for r in out))


def _evidence(spark: SparkSession, repo: str, commits: str) -> str:
    h = gitlog.read_history(spark, {"repo": repo})
    shas = spark.range(1).select(F.explode(citations.split_shas(F.lit(commits))).alias("p"))
    full = h.commits.join(F.broadcast(shas), F.startswith("sha", F.lower("p"))).select("sha")  # a few ids of the command line
    return "\n\n".join(r.block for r in citations.evidence_blocks(full, h.commits, h.changes).collect())


def _judge(spark: SparkSession, a: argparse.Namespace) -> int:
    """Judged by an external command that reads the prompt and writes its answer."""
    records = _records(spark, [a.record])
    options = records.select(citations.options(F.col("text")).alias("o")).first().o
    evidence = ""
    if a.commits:
        evidence = _evidence(spark, a.repo, a.commits)
    elif a.evidence:
        with open(a.evidence) as f:
            evidence = f.read()
    run = lambda prompt: subprocess.run(shlex.split(a.runner), input=prompt, capture_output=True, text=True).stdout
    v = votes.judge(spark, options, evidence, run, a.runs)
    if a.json:
        print(json.dumps(v, indent=2))
    else:
        print(f"overall: {v['overall']}  runs: {v['runs']}  agreement: {v['agreement']:.2f}")
        for o in v["options"]:
            print(f"  [{o['verdict']:11}] {o['option']}" + (f"  ({o['evidence']})" if o["evidence"] else ""))
    return int(v["overall"] != "pass")


def _closed(spark: SparkSession, repo: str, lookup: str):
    """Issues of workaround records that an external command, given the address, says are closed."""
    urls = gitlog.records(spark, repo).select(F.explode(citations.issue_urls(F.col("text"))).alias("url")).distinct().collect()  # issues that records name
    closed = []
    for r in urls:
        try:
            got = subprocess.run([*shlex.split(lookup), r.url], capture_output=True, text=True)
        except OSError:
            break
        if got.returncode == 0 and got.stdout.strip().upper() == "CLOSED":
            closed.append((r.url,))
    return spark.createDataFrame(closed, "url string")


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="histolith")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("analyze", help="candidates of a repository")
    a.add_argument("repo")
    a.add_argument("--history", default="full")
    a.add_argument("--code", default="repo")
    a.add_argument("--config")
    a.add_argument("--strategy", default="auto", choices=("auto", *pipeline.C.STRATEGIES))
    a.add_argument("--json", action="store_true")
    v = sub.add_parser("verify", help="check the citations of records")
    v.add_argument("records", nargs="+")
    v.add_argument("--repo", default=".")
    v.add_argument("--commits")
    v.add_argument("--rewrite", action="store_true", help="drop what doesn't hold and stamp provenance")
    v.add_argument("--write", action="store_true")
    v.add_argument("--json", action="store_true")
    j = sub.add_parser("judge-options", help="judge the considered options of a record by an external command")
    j.add_argument("record")
    j.add_argument("--runner", required=True, help="command that reads the prompt on its input and writes JSON")
    j.add_argument("--repo", default=".")
    j.add_argument("--commits", help="commits whose evidence is shown")
    j.add_argument("--evidence", help="file with the evidence, unless --commits is given")
    j.add_argument("--runs", type=int, default=3)
    j.add_argument("--json", action="store_true")
    w = sub.add_parser("check-workarounds", help="lifecycle of workaround records")
    w.add_argument("repo")
    w.add_argument("--strict", action="store_true")
    w.add_argument("--check-upstream", nargs="?", const="gh issue view --json state -q .state", metavar="COMMAND", help="command that prints the state of an issue, given its address")
    w.add_argument("--json", action="store_true")
    t = sub.add_parser("check-tags", help="parse-check annotated files")
    t.add_argument("repo")
    t.add_argument("files", nargs="+")
    t.add_argument("--json", action="store_true")
    e = sub.add_parser("evidence", help="evidence block of commits")
    e.add_argument("repo")
    e.add_argument("--commits", required=True)
    args = p.parse_args(argv)
    cfg = Config()
    if args.what == "analyze":
        try:
            cfg = Config.from_file(args.config)
        except (OSError, json.JSONDecodeError) as err:
            print(f"error: could not load config {args.config!r}: {err}", file=sys.stderr)
            return 2
    spark = SparkSession.builder.appName("histolith").getOrCreate()
    if args.what == "analyze":
        m = pipeline.analyze_repository(spark, args.repo, args.history, args.code, cfg, args.strategy)
        print(json.dumps(m, indent=2) if args.json else pipeline.report(m))
        return 0
    if args.what == "verify":
        return _verify(spark, args)
    if args.what == "judge-options":
        return _judge(spark, args)
    if args.what == "check-workarounds":
        closed = _closed(spark, args.repo, args.check_upstream) if args.check_upstream else None
        rows = citations.lifecycle(gitlog.records(spark, args.repo), gitlog.read(spark, "worktree", {"repo": args.repo}).select("path", "line"), closed).orderBy("path").collect()
        flagged = sum(bool(r.findings) for r in rows)
        if args.json:
            print(json.dumps({"records": [r.asDict() for r in rows], "checked": len(rows), "flagged": flagged}, indent=2))
            return int(args.strict and flagged > 0)
        for r in rows:
            print(f"  [{r.status:10}/{'FLAG' if r.findings else 'ok':4}] {r.path}")
            print("".join(f"      - {f}\n" for f in r.findings), end="")
        print(f"{flagged}/{len(rows)} workaround records flagged")
        return int(args.strict and flagged > 0)
    if args.what == "check-tags":
        rows = tags.check_syntax(spark.createDataFrame([(f,) for f in args.files], "path string"), args.repo).collect()
        if args.json:
            print(json.dumps([r.asDict() for r in rows], indent=2))
        for r in [] if args.json else rows:
            print(f"  [{r.status:7}] {r.path}" + (f"  — {r.detail}" if r.detail else ""))
        return int(any(r.status == "fail" for r in rows))
    print(_evidence(spark, args.repo, args.commits))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
