"""Connected components of a graph in DataFrames: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node that it reaches.

    A large star links each larger neighbour of a node to the smallest one, a small star each smaller; both
    keep the components, and repeated they leave a star around each smallest node. Neighbourhood minima
    are combined on the map side and joined back, so a hub's rows need not meet in a task. Each round is
    written to the shared folder. Self loops and repeated edges do no harm; null ends are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e, last = written(e), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # large has an edge from each node to smaller ones only.
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        before, e = e, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
