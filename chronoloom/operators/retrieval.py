"""Retrieval of context: candidates from several legs, ranked by decayed relevance, packed into a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.columns import candidate_score, decay, default_ttl_seconds, memory_class, soft_live, tokens_of, ttl
from chronoloom.operators.graph import both_ways, current
from chronoloom.operators.search import bm25, top

HOP_SCORE = 0.3
POOL = 100


def entity_candidates(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("entity").alias("kind"), "id", F.coalesce("summary", "name").alias("content"), memory_class().alias("memory"),
        F.col("created_at").alias("created"), ttl().alias("ttl"), F.lit(1.0).alias("confidence"), F.col("usage_count").cast("int").alias("usage"), F.col("last_recalled_at").alias("recalled"),
    )


def edge_candidates(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("edge").alias("kind"), "id", F.coalesce("fact", "relation").alias("content"), memory_class().alias("memory"),
        F.col("recorded_at").alias("created"), ttl().alias("ttl"), F.col("confidence").alias("confidence"), F.col("usage_count").cast("int").alias("usage"), F.col("last_recalled_at").alias("recalled"),
    )


def episode_candidates(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("episode").alias("kind"), "id", "content", memory_class().alias("memory"), F.col("recorded_at").alias("created"),
        default_ttl_seconds(memory_class()).alias("ttl"), F.lit(1.0).alias("confidence"), F.lit(0).alias("usage"), F.lit(None).cast("timestamp").alias("recalled"),
    )


def candidates(tables: dict[str, DataFrame], query: str, *, pool: int = POOL, patterns: int = 50, limit: int = 100, repeats: bool = False) -> DataFrame:
    """Candidates with a ``text_score``: the best of three text searches and the neighbours of the entities found.

    Each leg is cut to ``pool`` by TakeOrdered before anything is joined, so
    all joins have a side of at most ``pool`` rows. A current neighbour of a
    found entity has ``HOP_SCORE``; the higher score of a key wins. At most
    ``patterns`` patterns stay. With ``repeats`` rows that a table has more
    than once count once.
    """
    ents, edges, eps = tables["entities"].filter(soft_live()), tables["edges"].filter(soft_live()), tables["episodes"]
    legs = []
    found = None
    for df, cols, make in ((ents, ["name", "entity_type", "summary"], entity_candidates), (edges, ["fact", "relation"], edge_candidates), (eps, ["content", "source", "metadata"], episode_candidates)):
        hits = top(bm25(df, query, cols, id="id", repeats=repeats), pool, id="id")
        if df is ents:
            found = hits
        legs.append(make(df).join(F.broadcast(hits.withColumnRenamed("score", "text_score")), "id"))
    near = both_ways(current(edges)).join(F.broadcast(found.select(F.col("id").alias("a"))), "a").select(F.col("b").alias("id")).distinct()
    hop = entity_candidates(ents).join(near, "id", "left_semi").withColumn("text_score", F.lit(HOP_SCORE))
    every = reduce(DataFrame.unionByName, [*legs, hop])
    names = [c for c in every.columns if c not in ("kind", "id")]
    best = every.groupBy("kind", "id").agg(F.max_by(F.struct(*names), "text_score").alias("b")).select("kind", "id", "b.*")
    if patterns == 0:
        best = best.filter("memory <> 'pattern'")
    else:
        w = Window.partitionBy("memory").orderBy(F.desc("text_score"), "kind", "id")
        pat = best.filter("memory = 'pattern'").orderBy(F.desc("text_score"), "kind", "id").limit(patterns)
        best = best.filter("memory <> 'pattern'").unionByName(pat.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= patterns).drop("_r"))
    return best.orderBy(F.desc("text_score"), "kind", "id").limit(limit)


def rank(cands: DataFrame, now: Column) -> DataFrame:
    """Adds ``score``: decayed strength, confidence, relevance and use; rows with none are dropped."""
    d = decay(1.0, F.col("memory"), "created", F.col("ttl"), now, usage="usage", recalled="recalled")
    scored = cands.withColumn("score", candidate_score(d, F.col("memory"), "confidence", F.col("text_score"), "usage"))
    return scored.filter("score > 0")


def pack(ranked: DataFrame, budget: int, *, most: int) -> DataFrame:
    """Takes candidates in the order of their score as long as they fit, skipping those that don't.

    Not a running sum: a skipped item uses nothing. The fold runs over one array
    of the ``most`` rows that ``candidates`` was limited to (a feature: the
    number of memories asked for); a budget of 0 is empty.
    """
    costed = ranked.withColumn("tokens", tokens_of("content")).orderBy(F.desc("score"), "kind", "id").limit(most)
    row = F.struct((-F.col("score")).alias("o"), "kind", "id", "tokens", "score")
    order = costed.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    taken = order.select(
        F.expr(
            f"""aggregate(rows, named_struct('left', cast({int(budget)} AS bigint), 'ids', cast(array() AS array<struct<kind: string, id: string, tokens: bigint, score: double>>)),
                (a, r) -> IF(r.tokens <= a.left AND {int(budget)} > 0,
                    named_struct('left', a.left - r.tokens, 'ids', array_append(a.ids, named_struct('kind', r.kind, 'id', r.id, 'tokens', r.tokens, 'score', r.score))), a), a -> a.ids)"""
        ).alias("ids")
    )
    return taken.select(F.explode("ids").alias("x")).select("x.*")


def context(tables: dict[str, DataFrame], query: str, now: Column, *, budget: int = 20_000, limit: int = 100, patterns: int = 50, repeats: bool = False) -> DataFrame:
    """(kind, id, tokens, score): the memories to put before a model for ``query``."""
    return pack(rank(candidates(tables, query, limit=limit, patterns=patterns, repeats=repeats), now), budget, most=limit)
