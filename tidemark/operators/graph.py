"""Graphs as tables of edges: connected components and minimum spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept


def _print(links: DataFrame) -> tuple:
    """Tells a set of links from another: their number, and two mixtures of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), *(F.bit_xor(F.xxhash64(*links.columns, F.lit(i))) for i in range(2))).first())


def components(edges: DataFrame, *more: str) -> DataFrame:
    """node, root: the smallest node of each component, for all nodes of ``edges`` (a, b), numbers.

    With ``more`` columns, which join them to a node's name, each of their values is a graph of its own. Every round hangs
    a node's larger neighbours below the smallest one around it, first all of them and then the smaller ones among
    themselves, until nothing moves; a hub's neighbours are rows, never an array.
    """
    keys = list(more)
    links = kept(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _print(links)
    while True:
        # Each node's larger neighbours go to the smallest node it knows, itself included.
        both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Each node and its smaller neighbours go to the smallest of these.
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).where("v > m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        after = kept(small.unionByName(least.select(*keys, "u", F.col("m").alias("v"))).distinct(), "links")
        told = _print(after)
        links = after
        if told == seen:
            break
        seen = told
    return links.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, weight, with a < b) of a minimum spanning forest, by Borůvka's rounds.

    In a round every component takes its lightest edge to another (ties: the smallest a, then b), components so
    joined become one, and of the edges between two components the lightest stays. The number of components at least
    halves each time.
    """
    own = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("weight").alias("weight"))
    left = kept(own.select(F.col("a").alias("p"), F.col("b").alias("q"), F.struct("weight", "a", "b").alias("edge")), "edges")
    taken = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("q").alias("p"), F.col("p").alias("q"), "edge"))
        first = kept(both.groupBy("p").agg(F.min(F.struct("edge", "q")).alias("first")).select("p", "first.q", "first.edge"), "lightest")
        chosen = first.select("edge.a", "edge.b", "edge.weight").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        roots = components(first.select(F.col("p").alias("a"), F.col("q").alias("b")))
        for end in ("p", "q"):
            left = left.join(roots.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        left = left.where("p <> q").groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min("edge").alias("edge"))
        left = kept(left, "edges")
    return own.limit(0) if taken is None else taken
