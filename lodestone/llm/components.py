"""Connected components over an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of one orderable type -> (node, root) for every node that has an edge; root is
    the smallest node of its component. Loops, repeated edges and both directions are allowed,
    nulls are ignored; no edges give no rows.

    A round hooks every node to the smallest node among itself and its neighbours, parents jump to
    their parents' parents until all are roots (a chain's depth halves with each jump), then edges
    are rewritten between roots and loops vanish. A root that no node hooks to has a smaller
    neighbour in the next round, so two rounds at least halve a component's nodes: n nodes take at
    most 2 log2(n) rounds of log2(n) jumps, and no cap is needed. Minima are pre-aggregated by the
    sender, a hub never meets its neighbours in one task but in the joins, which adaptive execution
    may split. Every jump and round is written in the shared folder.
    """
    cur = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cur = materialize(cur, "cc-edges")
    steps: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(cur.select(F.col("a").alias("node"), F.col("b").alias("other")))
        parent = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("parent"))
        moved = True
        while moved:  # a parent's own parent is at most as large
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            before, jumped = parent, materialize(parent.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved")), "cc-parents")
            discard(before)
            parent, moved = jumped, not jumped.where("moved").isEmpty()
        parent = parent.select("node", "parent")
        steps.append(parent)
        pa, pb = parent.select(F.col("node").alias("a"), F.col("parent").alias("ra")), parent.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        last = cur
        cur = cur.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        cur = materialize(cur, "cc-edges")
        discard(last)
    if not steps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1].select("node", F.col("parent").alias("root"))
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("parent"), F.col("root"))
        out = step.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return out
