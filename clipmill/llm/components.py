"""Connected components of a link table by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmill.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node that has a link; ``comp`` is the component's smallest node.

    Each round hangs the larger neighbours of a node, then the smaller ones, on its smallest neighbour; the number of
    rounds grows with the logarithm of a component's diameter. A link keeps its smaller end until that has a still smaller
    neighbour, so minima are taken over smaller neighbours only, and a round shuffles the links four times and writes them once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, seen = stored(edges, "stars"), None
    while True:
        low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        # the smallest neighbour takes the node itself, the others are hung on it
        small = least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # every node now hangs on the smallest of its component; those are nodes too
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
