"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang each node's larger (or smaller) neighbours on its smallest one.

    ``edges`` has ``a > b``. The minimum of a node's neighbours is an aggregate
    joined back, so a node with very many neighbours stays spread.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(
            F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, for every node on an edge ``a, b``.

    Large-star and small-star steps alternate until nothing changes; each is
    written to the shared folder, so a lost executor repeats one step at most.
    """
    left = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = written(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = written(_stars(_stars(now, True), False), "cc")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
