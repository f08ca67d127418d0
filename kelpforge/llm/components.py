"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: each directed edge with the least of u and its neighbours; pre-aggregated before the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (long): root is the least node reachable.

    Edges between equal nodes, repeated edges and nulls are ignored; an empty table gives no rows. Each round is
    written to the shared folder, and removed when the next is; a round is repeated until the stars no longer change.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = materialize(pairs, "stars")
    mark = None
    while True:
        both = stars.select("u", "v").union(stars.select(F.col("v"), F.col("u")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _least(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        before, stars = stars, materialize(small.where("u <> v").distinct(), "stars")
        discard(before)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
