"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, scratch


def components(links: DataFrame) -> DataFrame:
    """Component of every node of ``links(a, b)``: (node, root), root being the smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): each
    step re-hangs a node's neighbours on the smallest one it sees, with a
    grouped minimum and a join, so that no neighbourhood is gathered in one
    place.  The table of links shrinks to stars in a logarithmic number of
    rounds; each round is written to the shared folder, which cuts the lineage.
    No links give an empty table; self links and repeated links change nothing.
    """
    with scratch(links.sparkSession):
        return _components(links)


def _components(links: DataFrame) -> DataFrame:
    edges = materialize(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components", outlives=True)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them, equal for equal tables."""
    r = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return r[0], r[1]
