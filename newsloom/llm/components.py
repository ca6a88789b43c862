"""Connected components of an edge table, by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import discard, stash


def _stars(both: DataFrame) -> DataFrame:
    """The least neighbour of each node that has an edge, itself included."""
    return both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = both.join(_stars(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = large.where("a > b").distinct()
    least = small.groupBy("a").agg(F.min("b").alias("m"))
    linked = small.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.withColumnRenamed("m", "b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of any integers -> (node, root): the least node that each node with an edge reaches.

    Rows are aggregated before every shuffle and joined on keys only; a node's neighbours are never gathered. Each round
    is written to the shared folder and replaces the one before, so a lost executor repeats one round at most. Self-loops and repeated edges are
    ignored; null ends are ignored; no edges give no rows. The number of rounds grows with the logarithm of the longest
    chain; the fingerprint of the edge set (count and sum of hashes) tells when nothing changes.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    mark, seen = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), None
    e = stash(e, "edges")
    while True:
        now = tuple(e.agg(mark.alias("x")).first().x)
        if now == seen:
            # a fixed point is a forest of stars that point at their least node
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, e = e, stash(_round(e), "edges")
        discard(before)
        seen = now
