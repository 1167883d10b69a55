"""Connected components by rounds of smallest-neighbour contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .work import discard, materialize


def digest(edges: DataFrame) -> tuple:
    """Count and order-free sums of two hashes of the edges: equal tables have equal digests."""
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total(F.xxhash64("u", "v")), total(F.xxhash64("v", "u"))).first())


#: A node with more edges than this, and than a HUBS-th of all, is a hub: there are at most 2 * HUBS of them.
HUB_EDGES, HUBS = 4096, 50_000


def with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (u, v) with m of ``least`` (u, m, n: edges of u). The rows of hubs are not dealt by their key, which would
    gather a hub's edges in one task: the hubs, of a number that does not grow with the edges, are broadcast."""
    limit = max(HUB_EDGES, n_edges // HUBS)
    if n_edges <= limit:
        return edges.join(least.drop("n"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > limit).select("u", F.col("m").alias("hub_m")))
    marked = edges.join(hubs, "u", "left")
    rest = marked.filter("hub_m is null").drop("hub_m").join(least.filter(F.col("n") <= limit).drop("n"), "u")
    return marked.filter("hub_m is not null").withColumnRenamed("hub_m", "m").unionByName(rest)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node that can be reached.

    Large-star and small-star rounds: edges are rewritten to smaller neighbours until all point at their component's
    smallest node. Every round is an aggregation and a join on keys, written to the shared folder, and the number of rounds
    grows with the logarithm of the longest chain. The centres of large stars are joined by broadcast (``with_least``)."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    first, mark = edges, digest(edges)
    while True:
        # large star: larger neighbours of u move to the least of u's neighbours and u itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_least(both, least, 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours of u, and u, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, low, 2 * mark[0]).select(F.explode(F.array_distinct(F.array("u", "v"))).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = materialize(small)
        mark, old = digest(new), mark
        if edges is not first:
            discard(edges)
        edges = new
        if mark == old:  # a round that changes nothing is the last
            break
    discard(first)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
