"""Git repositories as a Spark data source.

``spark.read.format("gitlog").option("repos", "name=/path;name2=/path2").option("table", "commits").load()``; tables: commits,
changes, diff_lines, merges, worktree (tracked lines), files (tracked source files whole) and range_diff (option range =
``base..head``; sha is the range). The log of a repository is read in partitions of ``SPAN`` commits, each streamed commit by commit. Fields are separated by control characters and paths come
NUL-terminated, so neither a pipe in a name nor a non-ASCII path shifts anything. The repositories must be reachable from the
executors; otherwise ``ingest`` them once to parquet and query that.
"""

from __future__ import annotations

import datetime
import os
import re
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from histolith.functions import vocabulary as V
from histolith.model import History

SCHEMAS = {
    "commits": "repo string, sha string, log_pos long, author string, date date, parents array<string>, subject string, body string",
    "changes": "repo string, sha string, ord int, status string, path string, old_path string",
    "diff_lines": "repo string, sha string, path string, ord int, sign string, content string",
    "merges": "repo string, merge_sha string, base_sha string, merge_date date, sha string",
    "worktree": "repo string, path string, line string",
    "files": "repo string, path string, text string",
    "range_diff": "repo string, sha string, path string, ord int, sign string, content string",
}


class GitError(RuntimeError):
    pass


def git(path: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "core.quotepath=off", "-c", "safe.directory=*", "-C", path, *args], capture_output=True)
    if done.returncode:
        raise GitError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def blocks(path: str, *args: str) -> Iterator[str]:
    """What git writes between record separators, one after the other; only one is held."""
    command = ["git", "-c", "core.quotepath=off", "-c", "safe.directory=*", "-C", path, *args]
    with tempfile.TemporaryFile() as errors, subprocess.Popen(command, stdout=subprocess.PIPE, stderr=errors) as run:
        held: list[bytes] = []
        while piece := run.stdout.read(1 << 20):
            *whole, rest = piece.split(b"\x1e")
            for w in whole:
                yield b"".join([*held, w]).decode("utf-8", "replace")
                held = []
            held.append(rest)
        yield b"".join(held).decode("utf-8", "replace")
        if run.wait():
            errors.seek(0)
            raise GitError(f"git {' '.join(args)}: {errors.read().decode(errors='replace').strip()}")


def ok(path: str, *args: str) -> bool:
    try:
        git(path, *args)
        return True
    except GitError:
        return False


#: Commits of a partition.
SPAN = 20_000
#: Extensions of files whose imports are known.
IMPORTING = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go")


def hunk_lines(patch: str) -> Iterator[tuple[str, int, str, str]]:
    """(path, ord, sign, content) of the changed lines of a patch without context, by the line counts of its hunks."""
    name = old = None
    n, left = 0, [0, 0]
    for line in patch.split("\n"):
        if left[0] > 0 and line.startswith("-"):
            left[0] -= 1
            yield name or old, n, "-", line[1:]
            n += 1
        elif left[1] > 0 and line.startswith("+"):
            left[1] -= 1
            yield name or old, n, "+", line[1:]
            n += 1
        elif line.startswith("diff --git"):
            name, old, n = None, None, 0
        elif line.startswith("--- "):
            old = line[6:].rstrip("\t") if line[4:6] == "a/" else None
        elif line.startswith("+++ "):
            name = line[6:].rstrip("\t") if line[4:6] == "b/" else None
        elif m := re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line):
            left = [int(m[1] or 1), int(m[2] or 1)]


class _Repo(InputPartition):
    def __init__(self, name: str, path: str, skip: int = 0, last: bool = True):
        self.name, self.path, self.skip, self.last = name, path, skip, last


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "commits")
        self.window = [options["range"]] if options.get("range") else []
        self.spec = ["--full-diff", "--", options["pathspec"]] if options.get("pathspec") else []
        spec = options.get("repos") or options["path"]
        self.repos = [(p.partition("=")[0], p.partition("=")[2]) if "=" in p else (p, p) for p in spec.split(";") if p]

    def partitions(self) -> list[_Repo]:
        if self.table not in ("commits", "changes", "diff_lines"):
            return [_Repo(*r) for r in self.repos]
        out = []
        for name, path in self.repos:
            merges = [] if self.table == "commits" else ["--no-merges"]
            try:
                n = int(git(path, "rev-list", "--count", *merges, *(self.window or ["HEAD"]), *self.spec[1:]))
            except GitError:
                n = 0
            cuts = [*range(0, max(1, n), SPAN)]
            out += [_Repo(name, path, c, c == cuts[-1]) for c in cuts]
        return out

    def read(self, partition: _Repo) -> Iterator[tuple]:
        self.at = partition
        for row in getattr(self, f"_{self.table}")(partition.path):
            yield (partition.name, *row)

    def _log(self, path: str, *args: str) -> Iterator[str]:
        span = [f"--skip={self.at.skip}", *([] if self.at.last else [f"--max-count={SPAN}"])]
        return blocks(path, "log", *span, *args, *self.window, *self.spec)

    def _commits(self, path: str) -> Iterator[tuple]:
        log = self._log(path, "--date=short", "--pretty=format:%H%x1f%an%x1f%ad%x1f%P%x1f%s%x1f%b%x1e")
        for n, block in enumerate((b for b in log if b.strip()), self.at.skip):
            sha, author, date, parents, subject, body = block.lstrip("\n").split("\x1f", 5)
            yield sha, n, author, datetime.date.fromisoformat(date), parents.split(), subject, body.strip() or None

    def _changes(self, path: str) -> Iterator[tuple]:
        for block in self._log(path, "--no-merges", "-z", "--name-status", "--pretty=format:%x1e%H"):
            if not block.strip():
                continue
            sha, fields = block[:40], [x.strip("\n") for x in block[40:].split("\0")]
            fields, at, n = [x for x in fields if x], 0, 0
            while at + 1 < len(fields):
                status = fields[at]
                two = status[0] in "RC"
                if two:
                    yield sha, n, status, fields[at + 2], fields[at + 1]
                else:
                    yield sha, n, status, fields[at + 1], None
                at, n = at + 2 + two, n + 1

    def _diff_lines(self, path: str) -> Iterator[tuple]:
        for block in self._log(path, "--no-merges", "-p", "--unified=0", "--no-color", "--pretty=format:%x1e%H"):
            for row in hunk_lines(block[40:]):
                yield block[:40], *row

    def _range_diff(self, path: str) -> Iterator[tuple]:
        base, _, head = self.window[0].partition("..")
        for row in hunk_lines(git(path, "diff", "--unified=0", "--no-color", base, head, *self.spec[1:])):
            yield self.window[0], *row

    def _files(self, path: str) -> Iterator[tuple]:
        for name in git(path, "ls-files", "-z").split("\0"):
            parts, full = name.split("/"), os.path.join(path, name)
            if os.path.splitext(name)[1].lower() in IMPORTING and not set(parts[:-1]) & set(V.WALK_SKIP) and os.path.isfile(full):
                with open(full, errors="replace") as f:
                    yield name, f.read()

    def _merges(self, path: str) -> Iterator[tuple]:
        for line in self._log(path, "--merges", "--date=short", "--pretty=format:%H%x1f%P%x1f%cd%x1e"):
            if not line.strip():
                continue
            sha, parents, date = line.strip().split("\x1f")
            p = parents.split()
            base = git(path, "merge-base", p[0], p[1]).strip()
            for own in git(path, "rev-list", "--no-merges", f"{base}..{sha}", *(["--", self.spec[-1]] if self.spec else [])).split():
                yield sha, base, datetime.date.fromisoformat(date), own

    def _worktree(self, path: str) -> Iterator[tuple]:
        for name in git(path, "ls-files", "-z").split("\0"):
            full = os.path.join(path, name)
            if name and os.path.isfile(full):
                with open(full, errors="replace") as f:
                    for line in f:
                        yield name, line.rstrip("\n")


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def read(spark: SparkSession, table: str, repos: dict[str, str], **options: str) -> DataFrame:
    spark.dataSource.register(GitLog)
    r = spark.read.format("gitlog").option("table", table).option("repos", ";".join(f"{k}={v}" for k, v in repos.items()))
    for k, v in options.items():
        if v:
            r = r.option(k, v)
    return r.load()


def read_history(spark: SparkSession, repos: dict[str, str], **options: str) -> History:
    return History(*(read(spark, t, repos, **options) for t in ("commits", "changes", "diff_lines")))


def ingest(spark: SparkSession, repos: dict[str, str], folder: str, **options: str) -> None:
    """Write all tables of repositories as parquet."""
    for t in SCHEMAS.keys() - {"range_diff"}:
        read(spark, t, repos, **options).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")


# Probes of one repository, before a run -----------------------------------------------------------------


def preflight(path: str, rev_range: str | None, output_dir: str) -> dict:
    try:
        count = int(git(path, "rev-list", "--count", rev_range or "HEAD"))
    except GitError:
        count = 0
    return {"shallow": git(path, "rev-parse", "--is-shallow-repository").strip() == "true", "commit_count": count, "next_adr": next_record_number(path, output_dir), "output_dir": output_dir}


def valid_ref(path: str, ref: str) -> bool:
    return ok(path, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")


def is_ancestor(path: str, ref: str, head: str = "HEAD") -> bool:
    return ok(path, "merge-base", "--is-ancestor", ref, head)


def next_record_number(path: str, output_dir: str) -> int:
    folder = os.path.join(path, output_dir)
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return max((int(m[1]) for m in (re.match(r"(\d{4})-.*\.md$", n) for n in names) if m), default=0) + 1


def source_roots(path: str, most: int = 200) -> list[str]:
    """Top directories that hold source code (each looked through up to ``most`` other files), and the usual ones."""
    found = set(V.LEGACY_SOURCE_ROOTS)
    skip = lambda d: d in V.NO_SOURCE_DIRS or d.startswith(".")
    for top in os.listdir(path) if os.path.isdir(path) else []:
        if skip(top) or not os.path.isdir(os.path.join(path, top)):
            continue
        others = 0
        for _, dirs, names in os.walk(os.path.join(path, top)):
            dirs[:] = [d for d in dirs if not skip(d)]
            if any(os.path.splitext(n)[1].lower() in V.SOURCE_EXTENSIONS for n in names[: most - others]):
                found.add(top)
                break
            others += len(names)
            if others >= most:
                break
    return sorted(found)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of the numbered records under any ``docs/decisions``."""
    keep = []
    for folder, dirs, names in os.walk(path):
        dirs[:] = [d for d in dirs if d not in V.WALK_SKIP and not d.startswith(".")]
        if folder.replace(os.sep, "/").endswith("docs/decisions"):
            keep += [os.path.join(folder, n) for n in names if re.match(r"\d{4}-.*\.md$", n)]
    if not keep:
        return spark.createDataFrame([], "path string, text string")
    df = spark.read.text([f"file://{p}" for p in sorted(keep)], wholetext=True)
    rel = F.replace(F.col("_metadata.file_path"), F.lit(f"file://{os.path.abspath(path)}/"), F.lit(""))
    return df.select(F.regexp_replace(rel, "^file:/*" + re.escape(os.path.abspath(path).lstrip("/")) + "/", "").alias("path"), F.col("value").alias("text"))
