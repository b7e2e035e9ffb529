"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component (the smallest node that links reach) for every node with a link.

    links: columns u, v (long); either order, repeats and links to itself do not matter. The links stay
    distributed; each round writes its table to the shared folder, and the driver sees a count and a
    checksum. Rounds grow with the logarithm of the longest chain. With `rounds`, it ends after so many:
    nodes of one component may then have different, but never foreign, component ids.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None if rounds else _state(edges)
    done = 0
    while done != rounds and (state is None or state[0]):
        new = stored(_small(_large(edges)), "stars")
        now = None if rounds else _state(new)
        forget(edges)
        edges, done = new, done + 1
        if not rounds and now == state:
            break
        state = now
    if rounds:  # a node may still have several; the smallest is nearest to the end
        own = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    else:
        own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().join(own.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return own.unionByName(roots)
