"""Consolidating pairwise matches into groups: alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.common import drop_table, table

#: A node with over this share of all edge ends has its minimum broadcast: there are at most 1000 such nodes.
HOT_SHARE = 1000


def _with_least(ends: DataFrame, total: int) -> DataFrame:
    """Adds to (u, v) the least of u and its neighbours as ``m``.

    The minimum is a plain aggregate with map-side partials. Joining it back
    would send all ends of a hub to one task, so the minima of hubs, at most
    ``HOT_SHARE`` by their definition, go to the ends by broadcast instead.
    """
    least = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    if total <= 1000:  # no node can have that many ends
        return ends.join(least.drop("n"), "u")
    hot = least.filter(F.col("n") > max(total // HOT_SHARE, 1000)).select(F.col("u").alias("h"), F.col("m").alias("hm")).collect()
    if not hot:
        return ends.join(least.drop("n"), "u")
    hubs = F.broadcast(ends.sparkSession.createDataFrame(hot, f"h {ends.schema['u'].dataType.simpleString()}, hm {ends.schema['u'].dataType.simpleString()}"))
    marked = ends.join(hubs, F.col("u") == F.col("h"), "left")
    rest = marked.filter("h IS NULL").select("u", "v").join(least.drop("n"), "u")
    return marked.filter("h IS NOT NULL").select("u", "v", F.col("hm").alias("m")).unionByName(rest)


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes keep them from being stars: linked to two nodes, or linked and linked to.

    Stars don't change any more, so the rounds need no extra one to find out.
    """
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("hub"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("hub")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("hub").alias("hub"))
    got = per.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("hub") > 0))).alias("bad")).first()
    return got.n, got.bad


def components(pairs: DataFrame, *, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``component``): the least member of each node's connected component.

    ``pairs`` are undirected matches. Nodes are compared in the order of their
    type (strings by code points). Pairs with a null end are ignored, self
    pairs keep their node as a component of its own, repeats and reversed pairs
    change nothing, an empty input gives an empty result; other columns are
    ignored.

    Large-star: every larger neighbour of a node is linked to the least one;
    small-star: every node and its smaller neighbours are linked to the least.
    Both are distributed joins and aggregates; the rounds end when all edges are
    stars, which no further round would change; that takes about log^2 of the
    longest chain. Each round's
    edges are written to the shared folder, older ones are deleted.
    """
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    alone = ends.filter("u = v").select("u").distinct()
    edges = table(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total, unsettled = _state(edges)
    for _ in range(most_rounds):
        if not unsettled:
            break
        # large-star over both directions
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * total).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.distinct(), "large")
        # small-star over edges from the larger end
        got = _with_least(large, total)
        small = got.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        new = table(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "small")
        drop_table(edges)
        drop_table(large)
        edges = new
        total, unsettled = _state(edges)
    if unsettled:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("u")).distinct()
    out = edges.unionByName(roots.select("u", F.col("u").alias("v")))
    alone = alone.join(out.select("u"), "u", "left_anti").select("u", F.col("u").alias("v"))
    return out.unionByName(alone).select(F.col("u").alias("node"), F.col("v").alias("component"))


def groups_by_shared_value(df: DataFrame, *, node: str, value: str) -> DataFrame:
    """(``node``, ``group_id``) of nodes tied, over any number of steps, by equal values; groups of one are left out.

    A value with many nodes becomes a star, not all pairs: each node is linked
    to the least node of its value. That least node is found in two steps, by
    (value, bucket of the node) and then by value, so that a value with a third
    of all rows is spread over the buckets. Null nodes and values tie nothing.
    """
    buckets = 64
    rows = df.select(F.col(node).alias("u"), F.col(value).alias("x")).dropna().distinct()
    rows = rows.withColumn("s", F.pmod(F.xxhash64("u"), F.lit(buckets)))
    part = rows.groupBy("x", "s").agg(F.min("u").alias("m"))
    top = part.groupBy("x").agg(F.min("m").alias("v"))
    links = rows.join(part, ["x", "s"]).select("u", F.col("m").alias("v"))
    links = links.unionByName(part.join(top, "x").select(F.col("m").alias("u"), "v")).filter("u <> v")
    return components(links, a="u", b="v").select(F.col("node").alias(node), F.col("component").alias("group_id"))
