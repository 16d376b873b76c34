"""Connected components over an edge table, by alternating star contractions.

Each round points every node at the smallest node it knows (large star: among its larger
neighbours; small star: among its smaller ones). The edge set never grows, the number of
rounds is logarithmic, and each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` hold (a, b) with a > b. Large: for each node, larger neighbours move to its
    least neighbour. Small: smaller neighbours and the node itself do."""
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) for every node that has an edge.
    ``edges``: longs ``a`` and ``b`` in any order; self-loops and repeats are ignored."""
    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    while True:
        after = materialize(_star(_star(now, large=True), large=False), "edges")
        # Stars over the same edges are the fixed point: nothing changed.
        changed = now.join(after, ["a", "b"], "left_anti").limit(1).count() or (
            after.join(now, ["a", "b"], "left_anti").limit(1).count()
        )
        discard(now)
        now = after
        if not changed:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    out.stage_path = now.stage_path  # for who wants to discard it
    return out
