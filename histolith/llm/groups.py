"""Consolidating pairwise matches into groups by random contraction.

Each round draws a fresh hash order of the vertices; every vertex hooks to the vertex of its closed
neighbourhood that comes first, the edges are relabelled and deduplicated, and loops vanish. A constant share of the
vertices disappears per round in expectation, whatever the shape of the graph (long chains and stars alike),
so the rounds are logarithmic. The mappings of the rounds are then expanded backwards. Everything is a shuffle on
a vertex id with reduction before it; nothing is collected but the count of remaining edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from histolith.session import forget, written


#: Rounds that are expanded in one plan.
EXPAND = 3


def connected_groups(edges: DataFrame, seed: int = 7, max_rounds: int = 200) -> DataFrame:
    """``edges(a, b)`` of one type to ``(id, grp)``: every vertex and the smallest vertex of its group.

    Edges with a null end are ignored; a loop makes its vertex a group of its own; repeats and directions don't
    matter; no edges give no rows; other columns are ignored.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    loops = e.where("a = b").select(F.col("a").alias("id"))
    live = written(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while True:
        if len(steps) >= max_rounds:
            raise RuntimeError(f"{max_rounds} rounds did not contract the graph")
        r = len(steps)
        if live.limit(1).count() == 0:
            break
        order = lambda v, r=r: F.struct(F.xxhash64(F.lit(seed + r), v).alias("h"), F.col(v).alias("v"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.least(order("a"), order("b")).alias("to")), F.struct(F.col("b").alias("id"), F.least(order("a"), order("b")).alias("to")))).alias("x")
        step = written(live.select(ends).select("x.*").groupBy("id").agg(F.min("to").alias("to")).select("id", F.col("to.v").alias("to")), "hooks")
        moved = live.join(step.select(F.col("id").alias("a"), F.col("to").alias("p")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("q")), "b")
        after = written(moved.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        forget(live)
        live = after
        steps.append(step)
    if not steps:
        return loops.distinct().select("id", F.col("id").alias("grp"))
    # expand: the label of a vertex of round k is the label that its hook has in round k + 1
    labels = steps[-1].select("id", F.col("to").alias("label"))
    for n, step in enumerate(reversed(steps[:-1]), 1):
        nxt = labels.select(F.col("id").alias("to"), "label")
        labels = step.join(nxt, "to", "left").select("id", F.coalesce("label", "to").alias("label"))
        if n % EXPAND == 0:  # a short plan, and sizes that the planner knows
            labels = written(labels, "labels")
    labels = written(labels.unionByName(loops.distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))), "labels")
    smallest = labels.groupBy("label").agg(F.min("id").alias("grp"))
    return labels.join(smallest, "label").select("id", "grp")
