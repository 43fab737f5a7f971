"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipflow.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node onto its smallest neighbour.

    ``large``: the larger neighbours, taken over both directions; else the smaller ones,
    together with the node itself.
    """
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    near = near.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long edges -> ``(node, root)`` for every node that an edge touches.

    root is the smallest node of the component; the smallest node itself is included.
    Each round is written to the shared folder, so a lost executor costs one round.
    Null ends and loops are ignored.  An empty edge table gives an empty result.
    """
    at = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    seen = None
    while True:
        state = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        at = written(_star(_star(at, True), False), "edges")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        at.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
