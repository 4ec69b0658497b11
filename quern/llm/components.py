"""Connected components by alternating large-star and small-star steps, all on DataFrames.

The edges stay distributed; each round is cut, and only two numbers (their count and a
checksum) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, cut


HOT = 1000  # neighbours


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _pointed(edges: DataFrame, neighbours: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(v, m) for every edge (u, v), m being the least of u and its neighbours; and the table of (u, m).

    A node with more than `hot` neighbours would gather them in one task of the join. There are at most
    (rows / hot) such nodes, so they are broadcast, and only the others are shuffled.
    """
    least = cut(neighbours.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d"))
    hubs = F.broadcast(least.where(F.col("d") > hot).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("d") <= hot).select("u", "m"), "u")
    both = edges.join(hubs, "u").select("u", "v", "m").unionAll(rest.select("u", "v", "m"))
    return both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), least.select("u", "m")


def _large(edges: DataFrame, hot: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _pointed(both.where("v > u"), both, hot)[0].distinct()


def _small(edges: DataFrame, hot: int) -> DataFrame:
    linked, least = _pointed(edges, edges, hot)
    return linked.unionAll(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node that it reaches.

    Edges may repeat and have either direction; self-loops and edges with a null end are dropped.
    An empty table gives an empty result.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct())
    seen = _print(now)
    if seen[0]:
        hot = max(HOT, 2 * seen[0] // BROADCAST_ROWS)
        for _ in range(max_rounds):
            now = cut(_small(cut(_large(now, hot)), hot))
            if (new := _print(now)) == seen:
                break
            seen = new
        else:
            raise RuntimeError("the components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
