"""Connected components by alternating star contractions.

Both steps replace an edge by one to a smaller neighbour, so the number of
edges never grows and a few rounds end with every vertex linked to the
smallest of its component. The minimum per vertex is a partial aggregate, so a
vertex with very many edges is combined before the shuffle, and the join that
brings it back may be split where it is skewed. Each round is cut off with
``checkpoint()`` in the folder all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b); component is the smallest id reachable."""
    shared_dir(edges.sparkSession)
    links = (edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
             .distinct().checkpoint())
    state = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of x moves to the smallest of x and its neighbours.
        both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m")).select(
            "x", F.least("x", "m").alias("m"))
        large = (links.join(low, links.u == low.x).select("v", F.col("m").alias("u")))
        large = large.union(links.join(low, links.v == low.x).where("m < v").select("v", F.col("m").alias("u")))
        # Small star: the smaller neighbours of x move to the smallest of them.
        large = large.distinct()
        least = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        small = large.join(least, large.v == least.x).select(F.col("u").alias("v"), F.col("m").alias("u"))
        links = (small.where("v > u").union(least.select(F.col("x").alias("v"), F.col("m").alias("u")))
                 .distinct().checkpoint())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return links.select(F.col("v").alias("id"), F.col("u").alias("component")).union(roots)
