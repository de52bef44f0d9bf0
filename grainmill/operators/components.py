"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Label every node of an undirected edge table with its component's least node.

    Returns ``node`` and ``component`` for each node that has an edge to another
    node. Self-loops and repeated edges are ignored; null ends are dropped. Each
    round rewires edges to local minima (the two-star algorithm), so the number
    of rounds is logarithmic in the longest path and no adjacency list is held
    in one task: neighbours are reduced with ``min`` and joined back.
    """
    spark = edges.sparkSession
    space = Workspace(spark, name)
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    current = space.table("e0", pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    step, before = 0, None
    while True:
        # large star: every neighbour larger than the node points at the least of the neighbourhood
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = space.table(f"l{step}", large)
        # small star: the node and its smaller neighbours point at the least of them
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = space.table(f"e{step + 1}", small)
        # the sum of the ends falls until every edge points at its root
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        space.drop(f"l{step}", f"e{step}")
        current, step = after, step + 1
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
