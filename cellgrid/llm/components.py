"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import cut, splittable


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, name: str = "node") -> DataFrame:
    """edges: (u, v) of any ordered type. Returns (name, component): the least node that each node can reach.

    Alternates two steps until nothing changes. In the large step every node ties its larger neighbours to its least
    neighbour, in the small step its smaller ones and itself. Both are a minimum by node, combined before the shuffle,
    and a join in which only the edges' side may be skewed, which Spark splits. Rounds grow with the logarithm of the
    longest path; each is cut off from its lineage.
    """
    edges = edges.select("u", "v").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(splittable(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(splittable(low), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = cut(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias(name), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias(name), F.col("v").alias("component")).distinct())
