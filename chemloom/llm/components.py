"""Connected components of an undirected graph, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_unique


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node long, component long), the component being the smallest node reachable.

    Nodes without an edge to another node do not appear. Each round links the larger neighbours of a node to its smallest
    neighbour (large star), then the smaller ones (small star); the number of rounds grows with the logarithm of a
    component's size, and an aggregation by node never gathers a neighbourhood: only its minimum travels. Hubs, nodes with a
    large share of all links, are joined by broadcast.
    Empty edges give an empty result; repeated edges and loops are allowed; null ends are left out.
    """
    spark = edges.sparkSession
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = cut(e)
    total = e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_unique(both.filter("v > u"), low, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down, down_path = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_unique(down, low, ["u"], "n", total)
        small = joined.select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(joined.select(F.col("u").alias("x"), F.col("m").alias("y")))
        new, new_path = cut(small.filter("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        now = _digest(new)
        same = now == _digest(e)
        discard(spark, path, down_path)
        e, path, total = new, new_path, now[0]
        if same:
            found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    raise RuntimeError("components did not settle")


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
