"""Parse checks of annotated files by external parsers, a partition of paths at a time; a parser that is missing skips its files."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Parsers by extension; each fails with a non-zero status.
PARSERS = {
    ".py": ("python3", "-m", "py_compile"), ".js": ("node", "--check"), ".mjs": ("node", "--check"), ".cjs": ("node", "--check"),
    ".rb": ("ruby", "-c"), ".sh": ("bash", "-n"), ".bash": ("bash", "-n"), ".go": ("gofmt", "-e"),
}


def check_syntax(paths: DataFrame, root: str) -> DataFrame:
    """``paths(path)``, relative to ``root`` on a file system that all executors share, to ``(path, status, detail)``: ok, fail or skipped."""

    def one(path: str) -> tuple[str, str, str]:
        ext = os.path.splitext(path)[1].lower()
        if ext not in PARSERS:
            return path, "skipped", f"no checker for {ext or 'no-ext'}"
        argv = PARSERS[ext]
        if not shutil.which(argv[0]):
            return path, "skipped", f"{argv[0]} not on PATH"
        env = os.environ | {"PYTHONDONTWRITEBYTECODE": "1", "PYTHONPYCACHEPREFIX": os.devnull}
        if ext == ".py":
            argv = (argv[0], "-c", "import sys; compile(open(sys.argv[1], 'rb').read(), sys.argv[1], 'exec')")
        done = subprocess.run([*argv, os.path.join(root, path)], capture_output=True, text=True, env=env)
        if done.returncode == 0:
            return path, "ok", ""
        said = (done.stderr or done.stdout).strip().splitlines()
        return path, "fail", said[-1] if said else "parse error"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([one(p) for p in pdf.path], columns=["path", "status", "detail"])

    return paths.select("path").mapInPandas(run, "path string, status string, detail string")


def tag_report(checked: DataFrame) -> DataFrame:
    """``(checked, failed, ok)``."""
    fail = F.count_if(F.col("status") == "fail")
    return checked.agg(F.count(F.lit(1)).alias("checked"), fail.alias("failed"), (fail == 0).alias("ok"))
