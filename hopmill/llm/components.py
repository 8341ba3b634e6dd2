"""Connected components of a large edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopmill.llm.common import small, stash

#: Neighbours from which on a node is a hub.
HUB = 1000


def _unrest(edges: DataFrame) -> tuple[int, int]:
    """Nodes that keep edges (u > v) from being stars around their least node, by a second edge down or one to each side, and the most edges of a node."""
    down = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"))))
    ends = edges.select(down.alias("end")).groupBy("end.node").agg(F.sum("end.down").alias("down"), F.count("*").alias("n"))
    r = ends.agg(F.count(F.when((F.col("down") > 0) & (F.col("n") > 1), 1)), F.coalesce(F.max("n"), F.lit(0))).first()
    return r[0], r[1]


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m of their u, from least (u, m, n): hubs by broadcast, the rest by a join."""
    hubs = small(least.where(F.col("n") >= HUB).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") < HUB).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _round(e: DataFrame) -> DataFrame:
    """A large star and a small star of edges of which no node has as many as HUB; then none has in between, either."""
    of_u = Window.partitionBy("u")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.withColumn("m", F.least("u", F.min("v").over(of_u))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.where("v < u").withColumn("m", F.min("v").over(of_u))
    return down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _round_with_hubs(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    large = _with_least(both, stash(least, "least")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = stash(large.where("v < u"), "down")
    least = stash(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    joined = _with_least(down, least)
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Large star and small star in turn until the edges are stars (Kiveris and others, 2014): every round keeps at most as many
    edges as there are nodes and edges. While a node has HUB neighbours or more, a node's neighbours are never gathered (only
    their minimum), and the round writes what it reads twice; else a round is one query, since each query costs the driver memory. The minima of
    hubs (HUB neighbours or more, so they are few) are broadcast, so that a hub's rows do not meet in one task. The edges
    given are evaluated once. Rows with a null end are ignored; self
    loops name isolated nodes. An empty table gives an empty one.
    """
    e = stash(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null"), "given")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node"))
    e = stash(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while (unrest := _unrest(e))[0]:
        e = stash(_round(e) if unrest[1] < HUB else _round_with_hubs(e), "edges")
    return nodes.distinct().join(e.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
