"""Frequent patterns over episodes and skills made from their outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.columns import cut_at_word

# Relations that count as success and as failure.
SUCCESS = ("fixed", "resolved", "success")
FAILURE = ("deprecated", "failed", "abandoned")


def plain_episodes(episodes: DataFrame) -> DataFrame:
    """Episodes that aren't compressions of others; a null source is one of its own."""
    return episodes.filter("NOT (source <=> 'compression')")


def patterns(
    episodes: DataFrame, links: DataFrame, entities: DataFrame, edges: DataFrame, *, least: int = 3, least_types: int = 2, most: int = 20
) -> DataFrame:
    """(kind, key, types, episodes, confidence): what recurs in at least ``least`` episodes.

    Entity types, unordered pairs of names, and triplets of source, relation
    and target over current edges, each counted once an episode. Pairs are made
    from distinct (episode, name) rows only and pre-aggregated with map-side
    partials before the shuffle. Confidence is the share of all episodes that
    aren't compressions. Candidates with fewer than ``least_types`` entity types
    are dropped; the ``most`` most frequent remain, ties by key.
    """
    eps = plain_episodes(episodes).select(F.col("id").alias("episode_id")).distinct()
    total = eps.agg(F.count("*").alias("total"))
    ent = entities.select(F.col("id").alias("entity_id"), "name", F.col("entity_type").alias("type")).distinct()
    per = links.select("episode_id", "entity_id").distinct().join(eps, "episode_id", "left_semi").join(ent, "entity_id").select("episode_id", "name", "type").distinct()
    types = per.filter("type IS NOT NULL").groupBy("type").agg(F.countDistinct("episode_id").alias("n"))
    types = types.select(F.lit("type").alias("kind"), F.col("type").alias("key"), F.array("type").alias("types"), "n")
    # a frequent pair has two frequent names, so rare names go before pairs are made
    often = per.groupBy("name").agg(F.countDistinct("episode_id").alias("k")).filter(F.col("k") >= least).select("name")
    per = per.join(often, "name", "left_semi")
    a = per.select("episode_id", F.col("name").alias("a"), F.col("type").alias("ta"))
    b = per.select("episode_id", F.col("name").alias("b"), F.col("type").alias("tb"))
    pairs = a.join(b, "episode_id").filter("a < b").groupBy("a", "b").agg(F.countDistinct("episode_id").alias("n"), F.collect_set("ta").alias("x"), F.collect_set("tb").alias("y"))
    pairs = pairs.select(F.lit("pair").alias("kind"), F.concat_ws("|", "a", "b").alias("key"), F.array_sort(F.array_union("x", "y")).alias("types"), "n")
    e = edges.filter("valid_until IS NULL").join(eps, "episode_id", "left_semi").select("source_id", "relation", "target_id", "episode_id").distinct()
    s = ent.select(F.col("entity_id").alias("source_id"), F.col("name").alias("s"), F.col("type").alias("ts"))
    t = ent.select(F.col("entity_id").alias("target_id"), F.col("name").alias("t"), F.col("type").alias("tt"))
    tri = e.join(s, "source_id").join(t, "target_id").groupBy("s", "relation", "t").agg(F.countDistinct("episode_id").alias("n"), F.collect_set("ts").alias("x"), F.collect_set("tt").alias("y"))
    tri = tri.select(F.lit("triplet").alias("kind"), F.concat_ws("|", "s", "relation", "t").alias("key"), F.array_sort(F.array_union("x", "y")).alias("types"), "n")
    every = reduce(DataFrame.unionByName, [types, pairs, tri]).filter((F.col("n") >= least) & (F.size("types") >= least_types))
    kept = every.orderBy(F.desc("n"), "kind", "key").limit(most)
    return kept.join(F.broadcast(total)).select("kind", "key", "types", F.col("n").alias("episodes"), (F.col("n") / F.col("total")).alias("confidence"))


def described(patterns: DataFrame, *, most: int = 80) -> DataFrame:
    """Adds ``description``, a label cut at a word's end: the describer to use where no model is at hand."""
    words = F.regexp_replace("key", r"\|", F.when(F.col("kind") == "triplet", " ").otherwise(" and "))
    text = F.concat(words, F.lit(" ("), F.array_join("types", ", "), F.lit("), in "), F.col("episodes").cast("string"), F.lit(" episodes"))
    return patterns.withColumn("description", cut_at_word(text, most))


def skills(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """One skill for each pair of connected entity types with a success or failure among its edges.

    Successes and failures by relation, confidence as their share (0.5 without
    any), the most frequent relation (of equal ones the last by name), and a description.
    """
    typ = entities.select("id", F.col("entity_type").alias("type")).distinct()
    e = edges.select("id", "source_id", "target_id", "relation").distinct()
    e = e.join(typ.select(F.col("id").alias("source_id"), F.col("type").alias("s")), "source_id").join(typ.select(F.col("id").alias("target_id"), F.col("type").alias("t")), "target_id")
    per = e.filter("s IS NOT NULL AND t IS NOT NULL").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "relation").agg(F.count("*").alias("n"))
    ok, bad = F.col("relation").isin(*SUCCESS), F.col("relation").isin(*FAILURE)
    out = per.groupBy("a", "b").agg(
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("success_count"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("failure_count"),
        F.max(F.struct("n", F.col("relation"))).alias("m"),
    )
    out = out.filter("success_count + failure_count > 0")
    conf = F.col("success_count") / (F.col("success_count") + F.col("failure_count"))
    text = F.format_string("%s and %s: mostly %s, %d fixed, %d failed", F.col("a"), F.col("b"), F.col("m.relation"), F.col("success_count"), F.col("failure_count"))
    return out.select(
        F.sha2(F.concat_ws("|", "a", "b"), 256).alias("id"), "a", "b", F.col("m.relation").alias("relation"), "success_count", "failure_count", conf.alias("confidence"), text.alias("description")
    )


def supersede(new: DataFrame, old: DataFrame) -> DataFrame:
    """(old_id, superseded_by): old active skills that share any entity type with a new one; the surest replaces them, of equal ones the last id.

    Both have ``id`` and ``entity_types``, the new ones ``confidence``. They
    meet by single types; skills stand for pairs of types, so a type has at most
    as many skills as there are types.
    """
    each = lambda df, *c: df.select(*c, F.explode(F.array_distinct("entity_types")).alias("type"))
    was = each(old.filter("superseded_by IS NULL"), F.col("id").alias("old_id"))
    met = was.join(each(new, F.col("id").alias("new_id"), "confidence"), "type").filter("old_id <> new_id")
    best = met.groupBy("old_id").agg(F.max(F.struct("confidence", "new_id")).alias("x"))
    return best.select("old_id", F.col("x.new_id").alias("superseded_by"))


def visible(skills: DataFrame, agent: str) -> DataFrame:
    """Active skills that are shared or the agent's own."""
    return skills.filter("superseded_by IS NULL").filter((F.col("scope") == "shared") | (F.col("created_by_agent") == agent))


def f1(found: Column, expected: Column) -> Column:
    """Exact set F1 of two arrays; 1 where both are empty."""
    return scores(found, expected)["f1"]


def _scores(hits: Column, found: Column, expected: Column) -> Column:
    share = lambda n: F.when((F.size(found) == 0) & (F.size(expected) == 0), F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(hits / n)
    p, r = share(F.size(found)), share(F.size(expected))
    both = F.when((F.size(found) == 0) & (F.size(expected) == 0), F.lit(1.0)).otherwise(2.0 * hits / (F.size(found) + F.size(expected)))
    return F.struct(p.alias("precision"), r.alias("recall"), both.alias("f1"))


def scores(found: Column, expected: Column) -> Column:
    """Precision, recall and F1 of two arrays as sets; all 1 where both are empty, a side that alone is empty gives 0."""
    return _scores(F.size(F.array_intersect(found, expected)), F.array_distinct(found), F.array_distinct(expected))


def fuzzy_scores(found: Column, expected: Column) -> Column:
    """Precision, recall and F1 where a found text counts if it contains an expected one or lies in one, in any letter case.

    In the order of the arrays each found text takes the first expected one
    that fits and that none has taken.
    """
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    fits = lambda e, f: F.contains(e, f) | F.contains(f, e)

    def take(left: Column, f: Column) -> Column:
        at = F.array_position(F.transform(left, lambda e: fits(e, f)), True).cast("int")
        return F.when(at > 0, F.concat(F.slice(left, 1, F.greatest(at - 1, F.lit(0))), F.slice(left, at + 1, F.size(left)))).otherwise(left)

    rest = F.aggregate(low(found), low(expected), take)
    return _scores(F.size(expected) - F.size(rest), found, expected)


def best_per(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in ascending ``order``: an aggregate with map-side partials, no window over a hot group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(*by, "_b.*")
