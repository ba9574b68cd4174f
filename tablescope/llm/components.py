"""Connected components of an edge table by alternating star contraction.

Every round points neighbours at the smallest id seen next to them (large star, then small
star) until nothing moves; the number of rounds grows with the logarithm of the longest path.
Edges stay distributed. Each round is written to the shared checkpoint folder, so lineage
stays short and a lost executor costs one round at most. The minimum per node is aggregated
map-side; the join back to the edges is a shuffle join in the stage of that aggregate, so the
neighbours of one hot node are one task, which streams them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize


def _mark(links: DataFrame) -> tuple:
    """Row count and an order-free sum of row hashes: two equal tables have equal marks."""
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), hashed).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (columns a, b long, not null): component is the
    smallest id reachable. Self loops count as single nodes; an empty table gives no rows.

    A round keeps one row (u, smaller neighbour) per link, and (r, r) for the roots; it is the last one when
    it changes nothing.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    while True:
        # large star: every larger neighbour of u points at the smallest neighbour of u (or u)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(least, "u").filter("v >= u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: the smaller neighbours of u, and u, point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                F.struct("u", F.col("m").alias("v")))).alias("l")).select("l.*")
        links = materialize(small.filter("u >= v").distinct(), "links")
        mark = _mark(links)
        if mark == before:
            break
        before = mark
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
