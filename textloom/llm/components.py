"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import keep


#: Edges of a hub: more than one of HUBS of all edges, and more than LEAST.
HUBS, LEAST = 1000, 1000


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), any order -> (node, component): the smallest node reachable, for every node of an edge.

    Each round writes its edges in the shared folder, so that lineage stays short. Stars only ever
    link nodes to smaller ones. A hub is met by a partial aggregate before each shuffle; where edges look up
    the least neighbour of their node, the nodes with at least one of HUBS of all edges (2 * HUBS of them at
    most) are broadcast, so that a hub's edges stay where they are.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    size, before = now.count(), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        hubs = low.where(F.col("n") > max(LEAST, size // HUBS)).select("a", F.col("m").alias("hub"))
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))  # of a node only its larger neighbours move
        up = up.join(F.broadcast(hubs), "a", "left")
        rest = up.where("hub is null").join(low.select("a", "m"), "a").select("a", "b", "m")
        large = up.where("hub is not null").select("a", "b", F.col("hub").alias("m")).unionByName(rest)
        large = large.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_low.select("a", F.col("m").alias("b")))
        now = keep(small.where("a <> b").distinct(), "edges")
        size, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (size, total) == before or size == 0:
            break
        before = (size, total)
    else:
        raise RuntimeError("components did not settle")
    labels = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
