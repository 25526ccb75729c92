"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two grouped minimums and two joins; tables are written between rounds, so lineage stays short and nothing
but a count and a checksum reaches the driver. Nodes with a large share of the links are looked up by broadcast. Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm._common import discard, materialize


#: A node with more than one part in so many of all links is a hub: there are at most twice as many, which are sent to every task.
HUBS = 1000


def _told(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (with a) and m, from least (a, m and n, the number of a's rows): hubs are looked up where their rows stand, the others meet in a shuffle."""
    if total < HUBS:
        return rows.join(least.drop("n"), "a")
    hub = F.col("n") > total / HUBS
    hubs = F.broadcast(least.where(hub).select("a", F.col("m").alias("hub_m")))
    marked = rows.join(hubs, "a", "left")
    mapped = marked.where("hub_m is not null").withColumnRenamed("hub_m", "m")
    return mapped.unionByName(marked.where("hub_m is null").drop("hub_m").join(least.where(~hub).drop("n"), "a"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _told(both.where("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _told(edges, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: columns a and b, without nulls. Returns node and root, the least node it reaches, for every node with a link to another.

    An empty table gives an empty result; links of a node with itself are ignored; the order and repetition of links do not
    matter. Rounds grow with the logarithm of the number of nodes; max_rounds only ends what would never settle.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = (edges.count(), None)
    for _ in range(max_rounds):
        between = materialize(_large_star(edges, seen[0]), "links")
        new = materialize(_small_star(between, seen[0]), "links")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        discard(between)
        edges = new
        if tuple(state) == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
