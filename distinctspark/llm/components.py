"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distinctspark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour larger than a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return (
        both.join(least, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _print(edges: DataFrame) -> tuple:
    """What changes whenever the edge set changes."""
    h = F.xxhash64("u", "v")
    parts = [F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))]
    return tuple(edges.agg(F.count("*"), *parts).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v): the least node reachable.

    Each half step is a group-by with map-side minima and a join that Spark may split where a
    node is hot (minima are written first, so both sides of it are dealt out anew); no neighbour
    list is ever gathered.  Edges are written after each full step, so
    a lost executor costs one step.  NULL ends and loops are ignored; no links give no rows.
    """
    edges = materialize(links.select("u", "v").where("u != v").distinct(), "edges")
    seen = None
    while (now := _print(edges)) != seen and now[0]:
        seen = now
        edges = materialize(_small_star(_large_star(edges)), "edges")
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots)
