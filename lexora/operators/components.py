"""Connected components by hooking onto smaller neighbours and contracting what has met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.session import cut, forget


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", labels: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """Rows (node, component) for every node that an edge touches; component is the smallest node reachable.

    Null endpoints and self loops are ignored; repeated edges count once; no edges give no rows. In
    each round every vertex hooks onto its smallest neighbour, hooks are followed to their ends by
    doubling jumps, and the edges are carried over to those ends, where most of them fall away: every
    round at least halves what is not done, and a star is done in one. Each step is written to the
    shared folder and the one before it deleted; only whether edges are left reaches the driver. Edges
    that ``cut`` has written are read from there and not written again.

    ``labels`` are components already known, to which the edges are added.
    """
    a, b = F.col(src), F.col(dst)
    half = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("u"), b.alias("v"))
    if labels is not None:
        own, other = (labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "uv")
        half = half.join(own, "u", "left").join(other, "v", "left")
        half = half.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u != v")
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    todo = half.select(both.alias("e")).select("e.u", "e.v")
    if labels is not None or not hasattr(edges, "cut_path"):
        todo = cut(todo.distinct())
    given = labels
    for _ in range(max_rounds):
        if labels is not None and todo.isEmpty():
            break
        hooks = cut(todo.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("r")))
        while True:
            above = hooks.select(F.col("u").alias("r"), F.col("r").alias("top"))
            jumped = cut(hooks.select("u", "r").join(above, "r").select("u", F.col("top").alias("r"), (F.col("top") != F.col("r")).alias("moved")))
            forget(hooks)
            hooks = jumped
            if hooks.where("moved").isEmpty():
                break
        fresh = hooks.select(F.col("u").alias("node"), F.col("r").alias("component"))
        if labels is None:
            grown = cut(fresh)
        else:
            moved = labels.join(hooks.select("u", "r"), labels["component"] == hooks["u"], "left").select("node", F.coalesce("r", "component").alias("component"))
            grown = cut(moved.union(fresh.join(labels, "node", "left_anti")))
        left, right = hooks.select("u", F.col("r").alias("a")), hooks.select(F.col("u").alias("v"), F.col("r").alias("b"))
        rest = cut(todo.join(left, "u").join(right, "v").where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        forget(todo, hooks, labels if labels is not given else None)
        labels, todo = grown, rest
    forget(todo)
    return labels
