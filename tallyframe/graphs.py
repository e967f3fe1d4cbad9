"""Connected components by contraction: the edge table shrinks every round and is written, so that no lineage grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for all nodes of ``edges`` (columns ``a``, ``b``).

    Minima combine before their shuffle, so a node with a third of all edges costs a row per task.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, steps = materialize(pairs, "edges"), []
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        near = near.select("node", F.least("node", "least").alias("root"))
        far = near.select(F.col("node").alias("root"), F.col("root").alias("further"))
        near = near.join(far, "root").select("node", F.col("further").alias("root"))
        near = materialize(near, "roots")
        steps.append(near)
        moved = pairs.join(near.withColumnsRenamed({"node": "a", "root": "x"}), "a").join(near.withColumnsRenamed({"node": "b", "root": "y"}), "b")
        pairs = materialize(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        out = out.select("node", F.coalesce("next", "root").alias("root"))
    return materialize(out, "components")
