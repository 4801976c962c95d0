"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b) of any ordered type: component is the least node reachable.

    Rounds of hooking each node to its least neighbour, halving paths by
    pointer jumping, then contracting. Each round at least halves the nodes that
    still have edges, so there are logarithmically many. Minima are aggregated
    map-side, which takes the heat out of hubs; the joins can be split by AQE.
    Only one count a round reaches the driver; tables of a round go once the next is written.
    """
    kind = dict(edges.dtypes)["a"]
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    whole = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        hook = written(near.select("node", F.least("node", "m").alias("root")), "cc-hook")
        while True:  # root pointers strictly fall, so this ends after log2(chain) steps
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jump = written(hook.select("node", "root").join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "cc-jump")
            discard(hook)
            hook = jump
            if hook.where("moved").isEmpty():
                break
        roots = hook.select("node", "root")
        if whole is None:
            lifted = written(roots.withColumnRenamed("root", "component"), "cc-whole")
        else:  # nodes of earlier rounds follow their representative
            lift = roots.select(F.col("node").alias("component"), F.col("root").alias("next"))
            lifted = written(whole.join(lift, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "cc-whole")
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = written(live.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        for old in (live, hook, whole):
            discard(old)
        live, whole = rest, lifted
    discard(live)
    if whole is None:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return whole
