"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Each round points all neighbours of a node at the smallest of them; nodes with many
    neighbours meet a task only as partial minima. Rounds are few (logarithmic in the length
    of chains); each is written to shared storage, so no lineage grows.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    now = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while True:
        # large star: every neighbour above a node is pointed at the least of its neighbours and itself
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the neighbours below a node, and the node, are pointed at the least of them
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = joined.select(F.inline(ends)).where(F.col("a") != F.col("b")).distinct()
        now = stored(small, "edges")
        # done when every edge leads to a root: no node has two edges down, or one down and one up
        roles = now.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("b", F.lit(0), F.lit(1)))
        open_ = roles.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        crowded = (F.col("down") > 0) & (F.col("down") + F.col("up") > 1)
        if not open_.agg(F.count_if(crowded)).first()[0]:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
