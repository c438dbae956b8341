"""Connected components of a link table, by contraction over DataFrames.

Each round every node points at its smallest neighbour, pointers are followed
to their ends, and the links are rewritten onto those ends; links inside one
tree vanish. Node keys are spread by a hash, so a round leaves a constant share
of the links. Rounds are staged in the shared folder; no link reaches the
driver, and a hub costs a partial minimum per task, not a collected group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import stage_table


def _follow(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by the end of its chain."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = stage_table(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.col("above").isNotNull()).alias("moved")), "jump")
        moved = not jumped.where("moved").isEmpty()
        parents = jumped.select("node", "parent")
        if not moved:
            return parents


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; nodes are longs."""
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    links = stage_table(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct(), "links")
    layers = []
    while not links.isEmpty():
        both = links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min(key("y")).alias("m"))
        parents = least.where(F.col("m") < key("x")).select(F.col("x").alias("node"), F.col("m.v").alias("parent"))
        parents = _follow(stage_table(parents, "parents"))
        layers.append(parents)
        px = parents.select(F.col("node").alias("x"), F.col("parent").alias("px"))
        py = parents.select(F.col("node").alias("y"), F.col("parent").alias("py"))
        moved = links.join(px, "x", "left").join(py, "y", "left").select(F.coalesce("px", "x").alias("x"), F.coalesce("py", "y").alias("y"))
        links = stage_table(moved.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    if not layers:
        return links.select(F.col("x").alias("node"), F.col("y").alias("root"))
    out = layers[0]
    for layer in layers[1:]:
        # Roots of one layer are the nodes of the next.
        up = layer.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        out = stage_table(out.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")).unionByName(layer), "layer")
    roots = out.select(F.col("parent").alias("node"), F.col("parent")).distinct()
    return out.unionByName(roots).select("node", F.col("parent").alias("root"))
