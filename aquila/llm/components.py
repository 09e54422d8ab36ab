"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquila.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) for every node of ``edges`` (a, b) except the roots themselves.

    Each round replaces edges by edges to least neighbours; minima are combined within tasks first, and hubs are met
    only in joins. The edges are written each round, so a lost executor costs one round. Loops of a node to itself and
    repeated edges don't matter; nulls are not allowed.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("hi", "lo").cast("decimal(20,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        large = written(large, "large-star")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(written(root, "root"), "hi")
        now = written(small.select("hi", F.col("m").alias("lo")).unionByName(small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct(), "edges")
