"""The graph of entities and edges: neighbourhoods, traversal, induced subgraphs, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.common import drop_table, small_side, table
from chronoloom.functions.columns import soft_live, valid_at


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end as (a, b, edge): an OR of two join conditions becomes one equi-join. A loop appears once."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("id").alias("edge"))
    back = edges.filter("source_id <> target_id").select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.col("id").alias("edge"))
    return out.unionByName(back)


def current(edges: DataFrame) -> DataFrame:
    """Edges without an end of validity."""
    return edges.filter("valid_until IS NULL")


def as_of(edges: DataFrame, t: Column, known: Column | None = None) -> DataFrame:
    """Edges valid at ``t``; with ``known`` only those on record by then."""
    df = edges.filter(valid_at(t))
    return df.filter(F.col("recorded_at") <= known) if known is not None else df


def edges_of(edges: DataFrame, node: str, *, only_current: bool = False) -> DataFrame:
    """Live edges at either end of one node, latest record first."""
    df = edges.filter(((F.col("source_id") == node) | (F.col("target_id") == node)) & soft_live())
    return (current(df) if only_current else df).orderBy(F.desc("recorded_at"), "id")


def induced(edges: DataFrame, nodes: DataFrame, *, node: str = "id") -> DataFrame:
    """Edges with both ends among ``nodes``."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(n, F.col("source_id") == F.col("_n"), "left_semi").join(n, F.col("target_id") == F.col("_n"), "left_semi")


def touching(edges: DataFrame, nodes: DataFrame, *, node: str = "id") -> DataFrame:
    """Edges with at least one end among ``nodes``, each once."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    ids = both_ways(edges).join(n, F.col("a") == F.col("_n"), "left_semi").select(F.col("edge").alias("_e")).distinct()
    return edges.join(ids, F.col("id") == F.col("_e"), "left_semi")


def edges_of_episodes(edges: DataFrame, episodes: DataFrame, *, id: str = "id") -> DataFrame:
    """Edges whose provenance is one of ``episodes``."""
    return edges.join(episodes.select(F.col(id).alias("episode_id")), "episode_id", "left_semi").select(*edges.columns)


def traverse(edges: DataFrame, starts: DataFrame, *, depth: int = 2, only_current: bool = True, seed: str = "seed") -> DataFrame:
    """(seed, id, depth): the nodes within ``depth`` steps of each seed, over edges in either direction.

    Breadth first, all seeds at once: each round joins the last frontier with
    the edges and keeps what no earlier round has reached, so cycles cost
    nothing; it ends early when a frontier is empty. A frontier of checked
    small size is broadcast, a larger one is joined by shuffle. Seeds are at
    depth 0, whether they have edges or not.
    """
    ends = both_ways(current(edges) if only_current else edges).select("a", "b").distinct()
    front = starts.select(F.col(seed).alias("seed"), F.col(seed).alias("id"), F.lit(0).alias("depth")).dropna().distinct()
    seen = front = table(front, "front")
    for d in range(1, depth + 1):
        step = small_side(front.select("seed", F.col("id").alias("a")))
        new = ends.join(step, "a").select("seed", F.col("b").alias("id"), F.lit(d).alias("depth")).distinct()
        new = table(new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"), "front")
        if new.isEmpty():
            drop_table(new)
            break
        seen, front = seen.unionByName(new), new
    return seen


def neighbours(edges: DataFrame, nodes: DataFrame, *, node: str = "id", distinct: bool = True) -> DataFrame:
    """(node, neighbour) over live current edges, once each or once per edge."""
    n = nodes.select(F.col(node).alias("a")).distinct()
    got = both_ways(current(edges).filter(soft_live())).join(n, "a").select(F.col("a").alias("node"), F.col("b").alias("neighbour"))
    return got.distinct() if distinct else got


def contradictions(new: DataFrame, existing: DataFrame, *, threshold: float = 0.2) -> DataFrame:
    """(new_id, existing_id, silent): current live edges that say another target for the same source and relation.

    Edges of the new batch don't contradict each other. An existing edge less
    certain than ``threshold`` is to be ended silently, others are reported.
    """
    n = new.select(F.col("id").alias("new_id"), "source_id", "relation", F.col("target_id").alias("_t"))
    old = current(existing).filter(soft_live()).join(new.select("id").distinct(), "id", "left_anti")
    old = old.select(F.col("id").alias("existing_id"), "source_id", "relation", "target_id", F.coalesce("confidence", F.lit(1.0)).alias("_c"))
    return n.join(old, ["source_id", "relation"]).filter("target_id <> _t").select("new_id", "existing_id", (F.col("_c") < threshold).alias("silent")).distinct()


def invalidate(edges: DataFrame, ended: DataFrame, until: Column, *, by: str | None = None) -> DataFrame:
    """Ends the validity of edges that have none yet; with ``by`` notes the contradicting edge in the metadata.

    ``ended``: existing_id and, for ``by``, that column. The metadata of an
    edge with several contradictions names the least of them; unreadable
    metadata is replaced.
    """
    what = ended.groupBy(F.col("existing_id").alias("id")).agg(F.min(by).alias("_by") if by else F.lit(None).cast("string").alias("_by"))
    hit = edges.join(what.withColumn("_hit", F.lit(True)), "id", "left")
    note = F.map_from_arrays(F.array(F.lit("contradicted_by"), F.lit("contradicted_at")), F.array(F.col("_by"), until.cast("string")))
    old = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    old = F.map_filter(old, lambda k, _: ~k.isin("contradicted_by", "contradicted_at"))
    meta = F.when(F.col("_by").isNotNull() & F.col("valid_until").isNull(), F.to_json(F.map_concat(old, note))).otherwise(F.col("metadata"))
    return hit.withColumn("metadata", meta).withColumn("valid_until", F.when(F.col("_hit") & F.col("valid_until").isNull(), until).otherwise(F.col("valid_until"))).drop("_by", "_hit").select(*edges.columns)
