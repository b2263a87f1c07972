"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mrkit.session import checkpoint, without_estimate


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``links(a, b)``; a component is named by its smallest node.

    Every round takes the smallest name among the neighbours, tells it to the node that gave the old name too, and then
    follows the name once. So whole components move at once, and the rounds grow with the logarithm of a path. Minima
    are taken inside the tasks first, and joins leave large nodes to adaptive execution. Estimates of sizes end with each
    round and with the result, as callers join one result on the way to the next.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = without_estimate(checkpoint(both.toDF("node", "other")))
    state = without_estimate(checkpoint(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component"))))
    id_type = state.schema["node"].dataType
    while True:
        names = state.toDF("other", "name")
        near = both.join(names, "other").groupBy("node").agg(F.min("name").alias("near"))
        moved = state.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        own = F.struct("node", "component", "to")
        namer = F.struct(F.col("component").alias("node"), F.lit(None).cast(id_type).alias("component"), "to")
        told = moved.select(F.inline(F.array(own, namer)))
        moved = told.groupBy("node").agg(F.max("component").alias("component"), F.min("to").alias("to"))
        ahead = state.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        moved = moved.join(ahead, "to", "left")
        moved = without_estimate(checkpoint(moved.select("node", F.coalesce("beyond", "to").alias("new"), "component")))
        changed = moved.where("new <> component").limit(1).count()
        state = moved.select("node", F.col("new").alias("component"))
        if not changed:
            return state
