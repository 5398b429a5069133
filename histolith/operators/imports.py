"""Import graph of source files, and optional communities of it."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame, functions as F

from histolith.functions import vocabulary as V

SCRIPTS = ("js", "jsx", "ts", "tsx", "mjs", "cjs")


def _both(text: Column, pattern: str) -> Column:
    one, two = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def imports(files: DataFrame) -> DataFrame:
    """``files(path, text)`` to ``(path, raw)``: what each file imports, as it is written."""
    e = extension(F.col("path"))
    found = F.when(e == "py", _both(F.col("text"), V.PYTHON_IMPORT)).when(e.isin(*SCRIPTS), _both(F.col("text"), V.SCRIPT_IMPORT)).when(e == "go", F.regexp_extract_all("text", F.lit(V.GO_IMPORT), F.lit(1)))
    return files.select("path", F.explode(found).alias("raw")).where("raw <> ''").distinct()


def _normal(parts: Column) -> Column:
    """Path components without ``.`` and with ``..`` resolved (one that leads out of the tree stays)."""
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when((p == "..") & F.when(F.size(acc) > 0, up(acc)).otherwise(F.lit(False)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def import_edges(files: DataFrame) -> DataFrame:
    """``files(path, text)`` to distinct undirected ``(src, dst)``, src < dst: imports that resolve to a file of the set.

    Every import becomes its candidate paths in order of preference, which are joined with the files; the first that exists counts.
    Python: absolute, then relative to the importer; scripts: relative with eight suffixes; Go: the smallest path that ends in the last
    component.
    """
    raw = imports(files)
    e, base = extension(F.col("path")), F.expr("slice(split(path, '/'), 1, size(split(path, '/')) - 1)")
    module = F.translate(F.regexp_replace("raw", r"^\.+", ""), ".", "/")
    near = _normal(F.concat(base, F.split(module, "/")))
    python = F.array(*[F.concat(x, F.lit(s)) for x in (module, near) for s in (".py", "/__init__.py")])
    there = _normal(F.concat(base, F.split("raw", "/")))
    script = F.when(F.startswith(F.col("raw"), F.lit(".")), F.array(*[F.concat(there, F.lit(s)) for s in V.SCRIPT_SUFFIXES]))
    tried = F.when(e == "py", python).when(e.isin(*SCRIPTS), script)
    have = files.select(F.col("path").alias("target")).distinct()
    exact = raw.select("path", "raw", F.posexplode(tried).alias("n", "target")).join(have, "target").groupBy("path", "raw").agg(F.min_by("target", "n").alias("target"))
    go = raw.where(e == "go").select("path", "raw", F.concat(F.element_at(F.split("raw", "/"), -1), F.lit(".go")).alias("name"))
    named = have.where("target LIKE '%.go'").groupBy(F.element_at(F.split("target", "/"), -1).alias("name")).agg(F.min("target").alias("target"))
    hits = exact.select("path", "target").unionByName(go.join(named, "name").select("path", "target")).where("path <> target")
    return hits.select(F.least("path", "target").alias("src"), F.greatest("path", "target").alias("dst")).distinct()


def available() -> bool:
    """Whether a library for communities is installed."""
    return bool(importlib.util.find_spec("igraph") and importlib.util.find_spec("leidenalg"))


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """``(path, community)`` by the Leiden method with a fixed seed where a library for it is installed, else null (the feature is off).

    The libraries hold a graph in one process; graphs of over ten million edges are refused.
    """
    if not available():
        return None
    import igraph
    import leidenalg

    if edges.limit(10_000_001).count() > 10_000_000:
        raise ValueError("the graph is too large for a library in one process")
    names = [r.path for r in nodes.select("path").distinct().orderBy("path").collect()]
    at = {p: i for i, p in enumerate(names)}
    g = igraph.Graph(n=len(names), edges=[(at[r.src], at[r.dst]) for r in edges.orderBy("src", "dst").collect()])
    part = leidenalg.find_partition(g, leidenalg.ModularityVertexPartition, seed=42)
    rows = [(names[i], k) for k, members in enumerate(part) for i in members]
    return edges.sparkSession.createDataFrame(rows, "path string, community int")
