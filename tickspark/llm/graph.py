"""Connected components of an edge table, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickspark.llm.common import remove, scratch, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): for each id of edges (a, b), the smallest id that it reaches. No row for ids without an edge to another.

    Each round hangs every node's larger neighbours, then all but the smallest of its smaller ones, onto its
    smallest neighbour; the edges never grow in number, and end as stars, whose nodes' smallest neighbours are the result.
    Each round's tables are written, which cuts the lineage, and replace the last round's; the driver sees only whether
    all is done. Smallest neighbours are combined before the shuffle and stand in a table of their own, so the join with the edges of a
    hub is one that Spark broadcasts or splits.
    """
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    now = stored(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi"), path)
    for _ in range(most_rounds):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        up = F.col("v") > F.col("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max(up).alias("above"), F.max(F.when(~up, F.col("v"))).alias("most"), F.min(F.when(~up, F.col("v"))).alias("fewest"))
        nodes = scratch(spark, "nodes")
        least = stored(least, nodes)
        # stars: no node has neighbours on both sides, or different smaller ones
        if least.where("fewest is not null and (above or fewest < most)").isEmpty():
            remove(spark, path)
            return least.select(F.col("u").alias("id"), F.col("m").alias("component"))
        # large star: (m(u), v) for the larger neighbours v of u
        large = now.join(least.select(F.col("u").alias("lo"), "m"), "lo").select(F.col("m").alias("lo"), "hi")
        # small star: for u, its smaller neighbours and itself hang onto the smallest
        small = large.withColumn("m", F.min("lo").over(W.partitionBy("hi"))).select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        before, path = path, scratch(spark, "edges")
        now = stored(small, path)
        remove(spark, before)
        remove(spark, nodes)
    raise RuntimeError("components did not settle")
