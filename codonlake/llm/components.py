"""Connected components by alternating large-star and small-star steps; every round is a few shuffles, none on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm.common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links(a, b): root is the smallest node that can be reached.

    A hub's links are never gathered: its smallest neighbour is an aggregate with partial sums, and the join back is a
    shuffle join in which adaptive execution splits a hub's rows. The rounds grow with the logarithm of the size.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        edges = written(small.filter("v <> u").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("v").agg(F.min("u").alias("root"))
    return roots.select(F.col("v").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
