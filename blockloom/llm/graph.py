"""Connected components by star contraction, over edges that stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import HOT_LEAST, HOT_PARTS, drop, hot_keys, join_split, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u, u included.

    Partial aggregates carry hot nodes; the edges of a node that has a large part of all are dealt over salts.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    top, total = least.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = hot_keys(least.select("u", "n"), ["u"], total) if top > max(HOT_LEAST, total // HOT_PARTS) else None
    return join_split(edges, least.select("u", "m"), ["u"], hot)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = down.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("v"))
    return linked.union(own).filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long edges to (node, root): each node of an edge with the least node it reaches.

    Large-star and small-star rounds alternate until the edges stop changing. Each round's edges
    are written to the shared folder, so lineage and recovery stay short; the driver sees two
    numbers a round. Rounds grow with the logarithm of a component's diameter. Self-loops and
    repeated edges are harmless; no edges give an empty table.
    """
    now = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        large = materialize(_large_star(now), "edges")
        stars = materialize(_small_star(large), "edges")
        drop(large, now)
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = stars
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
