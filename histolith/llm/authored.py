"""Generated, minified or vendored source files: belief propagation over directory trees.

The files and directories of a repository form a tree. Each node has one of five hidden labels, hand-written,
generated, minified, vendored or blob. Names of files and first changed lines give a file evidence of its own; a directory with a telling name is
observed, and so is the root (hand-written). A compatibility of parent and child lets evidence travel: down from a directory
(``node_modules``) to the files below it, and up from files to their directory and so to silent siblings: where one file in a directory shows
nothing and its many siblings say that a tool wrote them, it is taken for one of them; where some are silent, they are not. On a tree,
max-product propagation is exact after one pass up and one pass down.

A pass is one aggregation or join per depth of the tree over the *directories* of that depth; files take part once on
the way up and once on the way down. Beliefs are whole numbers, so sums don't depend on
the order of rows. A directory with very many children is reduced before it is shuffled; joins are shuffles, whatever their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from histolith.functions import text as X
from histolith.session import written

LABELS = ("hand", "generated", "minified", "vendored", "blob")

# Names by which tools and third parties are known ---------------------------------------
LOCK_FILES = r"(?i)^(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|cargo\.lock|gemfile\.lock|composer\.lock|poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|podfile\.lock|mix\.lock|pubspec\.lock|packages\.lock\.json|flake\.lock|go\.sum)$"
GENERATED_FILES = r"(\.(generated|gen|g|designer|Designer)\.[A-Za-z0-9]+$)|(_generated\.[A-Za-z0-9]+$)|(^zz_generated\.)|(\.pb(\.gw)?\.(go|cc|h|c|cpp|swift|dart|rb|java)$)|(_pb2(_grpc)?\.pyi?$)|(_pb\.(js|d\.ts|rb)$)|(\.(freezed|mocks)\.dart$)"
MINIFIED_FILES = r"([.\-_]min\.(js|css|mjs|cjs|html)$)|(\.(bundle|chunk)\.(js|css|mjs)$)|(\.(js|css|mjs|ts)\.map$)"
HASHED_FILES = r"([.\-]|^)(?=[0-9a-f]*[0-9])[0-9a-f]{8,32}\.(chunk\.)?(js|css|mjs)$"
VENDOR_DIRS = r"(?i)^(node_modules|bower_components|jspm_packages|vendor|third[_-]?party|thirdparty|pods|carthage|site-packages|\.bundle|\.yarn)$"
GENERATED_DIRS = r"(?i)^(generated|__generated__|autogen|auto_generated|autogenerated|gen-src|generated-sources|lcov-report|htmlcov)$"
BUILT_DIRS = r"(?i)^(dist|\.next|\.nuxt|\.output|\.svelte-kit)$"
#: Build or report output only with the directory under it, as in ``target/classes`` or ``coverage/lcov-report``.
BUILT_PAIRS = r"(?i)(^|/)(target/(classes|debug|release|generated-sources)|build/(classes|generated|outputs|reports|intermediates)|coverage/lcov-report|bin/(debug|release)|obj/(debug|release))$"
#: A copy of a released version, as in ``external/name-1.18``.
VERSIONED_COPY = r"(?i)(^|/)(external|extern|externals|deps|contrib|ext)/[^/]*[-_]v?\d+(\.\d+)+[^/]*$"
#: Comment lines by which generators and bundled copies announce themselves; code that only quotes them isn't a comment.
COMMENT = r"^\s*(//|#|/\*|\*|--|<!--|;|%|\"\"\"|''')"
GENERATED_LINE = r"(?i)(code generated .*do not edit|^\W*@generated\b|\bauto(matic(ally)?)?[- ]?(generated|produced|created|built)\b|\b(generated|produced|written|emitted|created) (automatically|by the\b|by [\w.-]+ ?(v?\d|;|-|,|\.|$)|from [\w./-]+ ?([-;,.]|$))|regenerate instead of edit|(manual|hand|local) (changes|edits|modifications) (are|will be) (lost|overwritten)|(changes|edits) (made here )?will be (lost|overwritten)|do not (edit|modify|change)( this file)?( by hand| manually)?\b)"
VENDORED_LINE = r"(?i)(\b(bundled|vendored|unmodified|verbatim) (upstream |third[- ]party )?cop(y|ies)\b|\b(upstream|third[- ]party) copy\b|local (edits|changes) (are )?discouraged|\bvendored (from|copy)\b|\b(copied|imported) verbatim from\b)"
HEX_LINE = r"^\s*(0x[0-9A-Fa-f]{1,2},?\s*){12,}$|(\\x[0-9A-Fa-f]{2}){24,}"
BASE64_LINE = r"['\"`]?[A-Za-z0-9+/]{160,}={0,2}['\"`]?"

# Evidence and compatibilities, in hundredths of a nat -------------------------------------------------
#: What a sign says for its label, and what the lack of any sign says against each label but hand-written: one silent file outweighs
#: eight siblings that show signs (2000 against 250 each).
SIGN, SILENT = 1050, -2000
#: Observed labels and hard constraints: more than any sum of the others.
SURE = 1 << 50
#: Cost of a label other than hand-written below a hand-written directory: for a directory, for a file.
TURN = {"dir": -200, "file": -250}
#: Cost of one label other than hand-written below another; hand-written below any other label is impossible.
CROSS = -100


def line_flags(content: Column) -> dict[str, Column]:
    """What one changed line says of its file."""
    note = content.rlike(COMMENT)
    n = F.length(content)
    spaces = n - F.length(F.translate(content, " \t", ""))
    marks = n - F.length(F.translate(content, ";,{}()=.:&|?!+", ""))
    dense = (n >= 160) & (spaces * 50 < n) & (marks * 6 > n)
    return {
        "said_generated": note & content.rlike(GENERATED_LINE),
        "said_vendored": note & content.rlike(VENDORED_LINE),
        "said_minified": dense,
        "said_blob": (n >= 60) & (content.rlike(HEX_LINE) | content.rlike(BASE64_LINE)) & ~dense,
    }


FLAGS = ("said_generated", "said_vendored", "said_minified", "said_blob")


N = range(len(LABELS))


def _file_evidence() -> list[str]:
    base = "element_at(split(path, '/'), -1)"
    like = lambda *patterns: " OR ".join(f"{base} RLIKE '{_sql(p)}'" for p in patterns)
    sign = lambda *tests: f"IF({' OR '.join(tests)}, {SIGN}, {SILENT})"
    return [
        "0",
        sign(like(LOCK_FILES, GENERATED_FILES), "said_generated"),
        sign(like(MINIFIED_FILES, HASHED_FILES), "said_minified"),
        sign("said_vendored"),
        sign("said_blob"),
    ]


def _dir_evidence() -> list[str]:
    name = "element_at(split(dir, '/'), -1)"
    generated = f"{name} RLIKE '{_sql(GENERATED_DIRS)}' OR {name} RLIKE '{_sql(BUILT_DIRS)}' OR dir RLIKE '{_sql(BUILT_PAIRS)}'"
    vendored = f"{name} RLIKE '{_sql(VENDOR_DIRS)}' OR dir RLIKE '{_sql(VERSIONED_COPY)}'"
    return [f"IF(dir = '', {SURE}, 0)", f"IF({generated}, {SURE}, 0)", "0", f"IF({vendored}, {SURE}, 0)", "0"]


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _compatible(parent: int, child: int, kind: str) -> int:
    return 0 if parent == child else TURN[kind] if parent == 0 else -SURE if child == 0 else CROSS


def _with(df: DataFrame, prefix: str, cols: list[str]) -> DataFrame:
    """Add columns ``<prefix>0..``: each step of a message is a projection of its own, or expressions would multiply."""
    return df.selectExpr("*", *[f"CAST({c} AS BIGINT) AS {prefix}{i}" for i, c in enumerate(cols)])


def _message(df: DataFrame, out: str, own: list[str], kind: str, up: bool) -> DataFrame:
    """Add the message ``<out>0..`` of a child to its parent (up), by label of the parent, or of a parent to its child, by label of
    the child, relative to hand-written. ``own``: what the sender believes; ``kind``: what the child is."""
    df = _with(df, "_b", own)
    cost = lambda to, of: _compatible(to, of, kind) if up else _compatible(of, to, kind)
    df = _with(df, "_r", ["greatest(" + ", ".join(f"_b{of} + {cost(to, of)}" for of in N) + ")" for to in N])
    return _with(df, out, [f"_r{i} - _r0" for i in N]).drop(*[f"{x}{i}" for x in ("_b", "_r") for i in N])


def _cols(*prefixes: str) -> list[str]:
    return [f"{p}{i}" for p in prefixes for i in N]


def _parent(path: str) -> str:
    return f"substring({path}, 1, greatest(length({path}) - length(element_at(split({path}, '/'), -1)) - 1, 0))"


def label_files(files: DataFrame) -> DataFrame:
    """``files(repo, path, said_generated, said_vendored, said_minified, said_blob)`` to ``(repo, path, label)``.

    One row per (repo, cleaned path); repeats count once with all that their rows say. Null flags are false; rows with
    a null path are dropped, an empty path is a file without a name, a null repo is a repository of its own (``''``). An
    empty table gives no rows; other columns are ignored.
    """
    flags = [F.max(F.coalesce(f, F.lit(False))).alias(f) for f in FLAGS]
    files = files.where("path IS NOT NULL").groupBy(F.coalesce("repo", F.lit("")).alias("repo"), X.clean_path(F.col("path")).alias("path")).agg(*flags)
    files = _with(files.selectExpr("*", f"{_parent('path')} AS parent"), "u", _file_evidence()).drop(*FLAGS)
    files = written(_message(files, "m", _cols("u"), "file", up=True), "files")

    # directories, each with its depth; the root '' has depth 0
    leafy = written(files.groupBy("repo", F.col("parent").alias("dir")).agg(*[F.sum(f"m{i}").alias(f"s{i}") for i in N]), "leafy")
    above = "transform(sequence(0, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), 1, i), '/'))"
    dirs = leafy.selectExpr("repo", f"explode({above}) AS dir").distinct().selectExpr("*", "IF(dir = '', 0, size(split(dir, '/'))) AS depth")
    dirs = _with(dirs, "u", _dir_evidence()).join(leafy.hint("merge"), ["repo", "dir"], "left").fillna(0, _cols("s"))
    dirs = written(dirs, "dirs", by="depth")
    deepest = dirs.agg(F.max("depth").alias("d")).first().d
    if deepest is None:
        return files.select("repo", "path", F.lit(LABELS[0]).alias("label")).limit(0)

    # up: at each depth, what the children say is added to their parent
    levels: dict[int, DataFrame] = {}
    said: DataFrame | None = None
    for k in range(deepest, -1, -1):
        level = dirs.where(F.col("depth") == k).drop("depth")
        if said is not None:
            level = level.join(said.hint("merge"), ["repo", "dir"], "left").fillna(0, _cols("t")).selectExpr("repo", "dir", *_cols("u"), *[f"s{i} + t{i} AS s{i}" for i in N])
        levels[k] = written(_message(level, "m", [f"u{i} + s{i}" for i in N], "dir", up=True), f"up{k}")
        said = levels[k].where("dir <> ''").groupBy("repo", F.expr(_parent("dir")).alias("dir")).agg(*[F.sum(f"m{i}").alias(f"t{i}") for i in N])

    # down: what a directory believes without the child at hand
    cavity = [f"pu{i} + pd{i} + ps{i} - m{i}" for i in N]
    as_parent = lambda df: df.selectExpr("repo", "dir AS parent", *[f"{c} AS p{c}" for c in _cols("u", "s", "d")])
    done: list[DataFrame] = []
    for k in range(deepest + 1):
        level = levels[k].selectExpr("*", f"{_parent('dir')} AS parent")
        if k == 0:
            level = _with(level, "d", ["0"] * len(LABELS))
        else:
            level = _message(level.join(as_parent(done[-1]).hint("merge"), ["repo", "parent"]), "d", cavity, "dir", up=False)
        level = level.select("repo", "dir", *_cols("u", "s", "d"))
        done.append(written(level, f"down{k}") if k < deepest else level)
    believed = as_parent(reduce(DataFrame.unionByName, done))
    leaves = _message(files.join(believed.hint("merge"), ["repo", "parent"]), "d", cavity, "file", up=False)
    leaves = _with(leaves, "b", [f"u{i} + d{i}" for i in N])
    label = "CASE " + " ".join(f"WHEN b{i} = greatest({', '.join(_cols('b'))}) THEN '{x}'" for i, x in enumerate(LABELS)) + " END"
    # written: a filter on the label would be pushed down through all steps, each of which multiplies it
    return written(leaves.selectExpr("repo", "path", f"{label} AS label"), "labels")
