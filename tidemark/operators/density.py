"""Topics as dense regions of embeddings, and the words that tell them apart.

1. Equal vectors are one point with their number as weight. A point's *core distance* is that to its ``samples``-th
   nearest row, itself included. Two neighbours are as far apart as the largest of their distance and both core
   distances; these edges join each point to its ``neighbours`` nearest ones.
2. A minimum spanning forest of the edges says which points hang together at any distance.
3. The tree of clusters is looked at on a ladder of ``levels`` distances, quantiles of the forest's edges (each distinct
   one, if they are no more). A component of at least ``smallest`` rows is alive. Going down the ladder, a
   cluster goes on in the one alive component that is left of it, ends where none is, and splits where several are.
4. A cluster's stability is the sum over its rows of 1 / distance gained while they are in it; one that is whole at
   the top of the ladder begins there. Going up, a cluster is
   selected if it is at least as stable as what is selected below it. The only
   cluster at the top is selected only if it never splits. Rows in no selected cluster are noise.

Everything grows with rows, edges or clusters and is a table; the ladder alone goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..storage import kept
from . import graph, neighbours

LEVELS = 24


def points(vectors: DataFrame, id_: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Points (id, v, weight; the smallest id of equal vectors) and members (member, id). Vectors that are null, empty
    or hold a null or non-finite component are no points."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_).alias("member"), F.transform(v, lambda x: x + 0.0).alias("v")).where("member is not null and v is not null and size(v) > 0").where(whole)
    rows = kept(rows, "rows")
    own = kept(rows.groupBy("v").agg(F.min("member").alias("id"), F.count(F.lit(1)).alias("weight")), "points")
    return own, rows.join(own, "v").select("member", "id")


def reach(own: DataFrame, samples: int, k: int, **search) -> DataFrame:
    """a, b, weight: neighbours and how far apart they count as."""
    near = neighbours.nearest(own, k, **search)
    weights = own.select(F.col("id").alias("other"), F.col("weight").alias("n"))
    # Rows at each distance or nearer: at most k points for each.
    by = Window.partitionBy("id").orderBy("distance", "other").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = near.join(weights, "other").withColumn("rows", F.sum("n").over(by))
    enough = counted.join(own.select("id", "weight"), "id").where(F.col("rows") + F.col("weight") >= samples)
    core = enough.groupBy("id").agg(F.min("distance").alias("core"))
    most = near.groupBy("id").agg(F.max("distance").alias("most"))
    dense = own.where(F.col("weight") >= samples).select("id", F.lit(0.0).alias("none"))
    core = own.select("id").join(core, "id", "left").join(most, "id", "left").join(dense, "id", "left").select("id", F.coalesce("none", "core", "most", F.lit(0.0)).alias("core"))
    core = kept(core, "core")
    a, b = (core.select(F.col("id").alias(x), F.col("core").alias(f"core_{x}")) for x in ("a", "b"))
    edges = near.select(F.col("id").alias("a"), F.col("other").alias("b"), "distance").join(a, "a").join(b, "b")
    return edges.select("a", "b", F.greatest("distance", "core_a", "core_b").alias("weight"))


def ladder(forest: DataFrame, levels: int) -> list[float]:
    """Rising distances above zero, the largest edge last."""
    edges = forest.where("weight > 0")
    some = [r[0] for r in edges.select("weight").distinct().limit(levels + 1).collect()]
    if len(some) > levels:
        some = edges.approxQuantile("weight", [(i + 1) / levels for i in range(levels)], 0.0)
    return sorted(set(some))


def _alive(own: DataFrame, forest: DataFrame, steps: list[float], smallest: int) -> tuple[DataFrame, DataFrame]:
    """Points by level (id, level, root) and alive components (level, root, size)."""
    n = len(steps)
    first = sum(((F.col("weight") > F.lit(d)).cast("int") for d in steps), F.lit(0))  # the first level that holds the edge
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level")
    edges = forest.select("a", "b", first.alias("first")).where(F.col("first") < n).select("a", "b", F.explode(F.sequence("first", F.lit(n - 1))).alias("level"))
    roots = graph.components(edges, "level").withColumnRenamed("node", "id")
    placed = own.select("id", "weight", at).join(roots, ["id", "level"], "left").select("id", "weight", "level", F.coalesce("root", "id").alias("root"))
    placed = kept(placed, "placed")
    alive = placed.groupBy("level", "root").agg(F.sum("weight").alias("size")).where(F.col("size") >= smallest)
    return placed, kept(alive, "alive")


def _tree(placed: DataFrame, alive: DataFrame, steps: list[float]) -> DataFrame:
    """Clusters: level and root (where it begins, from above), up_level and up_root (those of its parent), stability."""
    above = placed.select(F.col("id").alias("root"), (F.col("level") - 1).alias("level"), F.col("root").alias("up"))
    nodes = alive.join(above, ["level", "root"], "left")  # a component's root is one of its points
    many = nodes.where("up is not null").groupBy("level", "up").agg(F.count(F.lit(1)).alias("n"))
    goes_on = nodes.join(many, ["level", "up"], "left").select("level", "root", "size", "up", (F.coalesce("n", F.lit(0)) == 1).alias("same"))
    # Where a node's cluster begins: itself, or where that of the node above begins; twice as far each time.
    begins = kept(goes_on.select("level", "root", "size", "up", "same", F.when(F.col("same"), F.col("level") + 1).otherwise(F.col("level")).alias("to_level"), F.when(F.col("same"), F.col("up")).otherwise(F.col("root")).alias("to_root")), "begins")
    for _ in range(len(steps).bit_length()):
        on = begins.select(F.col("level").alias("to_level"), F.col("root").alias("to_root"), F.col("to_level").alias("far_level"), F.col("to_root").alias("far_root"))
        begins = kept(begins.join(on, ["to_level", "to_root"]).select("level", "root", "size", "up", "same", F.col("far_level").alias("to_level"), F.col("far_root").alias("to_root")), "begins")
    shares = [1 / d for d in steps]
    gained = F.element_at(F.array(*(F.lit(a - b) for a, b in zip(shares, [*shares[1:], shares[-1]], strict=True))), F.col("level") + 1)
    stable = begins.groupBy(F.col("to_level").alias("level"), F.col("to_root").alias("root")).agg(F.sum(F.col("size") * gained).alias("stability"))
    heads = begins.where("not same").select("level", "root", "up")
    parent = begins.select((F.col("level") - 1).alias("level"), F.col("root").alias("up"), F.col("to_level").alias("up_level"), F.col("to_root").alias("up_root"))
    return kept(stable.join(heads, ["level", "root"]).join(parent, ["level", "up"], "left").select("level", "root", "up_level", "up_root", "stability"), "clusters")


def _selected(clusters: DataFrame) -> DataFrame:
    """level, root of the clusters that are at least as stable as what is selected below them."""
    done = None
    tops = clusters.where("up_level is null").select("level").limit(2).count()
    if tops == 1 and clusters.select("level").limit(2).count() > 1:
        # A cluster of everything says nothing where there are others.
        clusters = clusters.withColumn("stability", F.when(F.col("up_level").isNull(), -1.0).otherwise(F.col("stability")))
    at = sorted(r[0] for r in clusters.select("level").distinct().collect())  # no more than the ladder has
    for level in at:
        here = clusters.where(F.col("level") == level)
        if done is not None:
            below = done.groupBy(F.col("up_level").alias("level"), F.col("up_root").alias("root")).agg(F.sum("best").alias("below"))
            here = here.join(below, ["level", "root"], "left")
        else:
            here = here.withColumn("below", F.lit(None).cast("double"))
        here = here.select("level", "root", "up_level", "up_root", F.greatest("stability", F.coalesce("below", F.lit(0.0))).alias("best"), (F.col("stability") >= F.coalesce("below", F.lit(0.0))).alias("taken"))
        done = kept(here if done is None else done.unionByName(here), "best")
    # What lies below a taken cluster is part of it.
    if done is None:
        return clusters.select("level", "root")
    open_ = done.withColumn("covered", F.lit(False))
    for level in reversed(at):
        up = open_.where(F.col("taken") | F.col("covered")).select(F.col("level").alias("up_level"), F.col("root").alias("up_root"), F.lit(True).alias("over"))
        here = open_.where(F.col("level") == level).join(up, ["up_level", "up_root"], "left")
        here = here.select("level", "root", "up_level", "up_root", "best", "taken", (F.col("covered") | F.coalesce("over", F.lit(False))).alias("covered"))
        open_ = kept(open_.where(F.col("level") != level).unionByName(here), "open")
    return open_.where("taken and not covered").select("level", "root")


def clusters(vectors: DataFrame, id_: str, vector: str, smallest: int = 10, samples: int = 5, k: int = 15, levels: int = LEVELS, **search) -> DataFrame:
    """The id of each vector that is a point, and its ``topic``: the smallest point of its cluster, or null for noise."""
    own, members = points(vectors, id_, vector)
    forest = kept(graph.spanning_forest(reach(own, samples, max(k, samples), **search)), "forest")
    steps = ladder(forest, levels) or [1.0]
    placed, alive = _alive(own, forest, steps, smallest)
    chosen = _selected(_tree(placed, alive, steps))
    topics = placed.join(chosen, ["level", "root"]).select("id", F.col("root").alias("topic"))
    return members.join(topics, "id", "left").select(F.col("member").alias(id_), "topic")


def class_terms(docs: DataFrame, group: str, text: str | Column, k: int = 10, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """group, rank, term, weight: a term's share of a group's words times ln(1 + words a group / occurrences at all)."""
    terms = docs.where(F.col(group).isNotNull()).select(group, F.explode(words(F.col(text) if isinstance(text, str) else text, stop_words)).alias("term"))
    counts = kept(terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("n")), "terms")
    sizes = counts.groupBy(group).agg(F.sum("n").alias("words"))
    total = counts.groupBy("term").agg(F.sum("n").alias("all"))
    mean = sizes.agg(F.avg("words").alias("mean"))
    weighed = counts.join(sizes, group).join(total, "term").join(F.broadcast(mean))  # one row
    weight = F.col("n") / F.col("words") * F.log1p(F.col("mean") / F.col("all"))
    by = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return weighed.select(group, "term", F.round(weight, 9).alias("weight")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
