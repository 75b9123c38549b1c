"""Connected components of a link table by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradus.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reached.

    Alternates large-star and small-star steps: each node hands its greater, then its smaller neighbours to the
    smallest one it knows. The table stays below twice the links, smallest neighbours are partial aggregates, and
    each round is written to the shared folder, so nothing grows with the size of a component.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = written(edges, "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = written(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    star = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return star.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
