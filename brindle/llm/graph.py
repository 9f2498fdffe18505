"""Connected components of a table of links, without bringing any node's links together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_tables, table


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b) the smallest node it is linked with, over any number of links.

    Alternating stars: a round hangs every node's larger neighbours below its
    smallest one, then every node and its smaller neighbours.  Only minima are
    aggregated and joins are on nodes, so a hub is split by AQE.  The rounds
    needed grow with the logarithm of a component's size.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.min("b").alias("m"))

    # a > b throughout
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = table(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(least(large), "a")
        after = table(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "links")
        drop_tables(links.sparkSession, edges)
        edges = after
        # done when every node hangs below one other, which hangs below none
        below = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        heads = edges.select(F.col("b").alias("a")).distinct().withColumn("head", F.lit(True))
        if not below.join(heads, "a", "left").where("n > 1 or head").head(1):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
