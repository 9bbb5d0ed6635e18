"""Connected components of an edge table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lookup_join


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, ws: Workspace, name: str = "edges", most_rounds: int = 60) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for each node u that is not the smallest itself.

    edges: (u, v) long, any direction; loops and repeats are ignored. Each round is written to shared storage. A node with a
    large share of the edges is looked up by broadcast, so no task gets its whole neighbourhood.
    """
    pairs = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = ws.table(pairs, f"{name}-0")
    state = _state(now)
    for k in range(1, most_rounds + 1):
        if not state[0]:
            return now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup_join(both, least.select("u", "m"), "u", "inner", sizes=least.select("u", "n"))
        large = large.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = ws.table(large, f"{name}-{k}-large")
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        new = ws.table(small, f"{name}-{k}")
        ws.drop(f"{name}-{k}-large")
        ws.drop(f"{name}-{k - 1}")
        now, old, state = new, state, _state(new)
        if state == old:
            return now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
