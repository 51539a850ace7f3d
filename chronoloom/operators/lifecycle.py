"""Life of memories: recall, decay, staleness, renewal, expiry and cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.columns import GRACE_SECONDS, archived, decay, default_ttl_seconds, memory_class, seconds, soft_live, ttl


def set_json(metadata, values: dict[str, Column]) -> Column:
    """Sets keys of a flat JSON object as text; unreadable or null JSON starts anew."""
    old = F.coalesce(F.from_json(F.col(metadata), "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(*values))
    new = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(v.cast("string") for v in values.values())))
    return F.to_json(F.map_concat(kept, new))


def touch(rows: DataFrame, log: DataFrame, *, log_id: str = "entity_id", at: str = "recalled_at") -> DataFrame:
    """Adds the recalls of a log to usage_count and last_recalled_at.

    The log is aggregated (with map-side partials) before it is joined, so a
    row recalled a billion times is one row by then. Recalls without an id are
    ignored, those without a time count but set none.
    """
    uses = log.filter(F.col(log_id).isNotNull()).groupBy(F.col(log_id).alias("id")).agg(F.count("*").alias("_n"), F.max(at).alias("_at"))
    got = rows.join(uses, "id", "left")
    return got.withColumns(
        {
            "usage_count": (F.coalesce("usage_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint"),
            "last_recalled_at": F.greatest("last_recalled_at", "_at"),
        }
    ).select(*rows.columns)


def strength(now: Column, *, created: str) -> Column:
    return decay(1.0, memory_class(), created, ttl(), now, usage="usage_count", recalled="last_recalled_at")


def stale(rows: DataFrame, now: Column, *, created: str, threshold: float = 0.5, prefilter: bool = False) -> DataFrame:
    """Rows with a time to live whose strength is below ``threshold``, with the action it calls for.

    Above 0.7 keep, above 0.3 update, else expire. ``prefilter`` also demands an
    age of 180 days times (1 - threshold), which misses short-lived classes.
    """
    df = rows.filter("ttl_seconds > 0")
    if prefilter:
        df = df.filter(seconds(now) - seconds(created) > int(180 * 86_400 * (1 - threshold)) * 1_000_000)
    df = df.withColumn("strength", strength(now, created=created)).filter(F.col("strength") < threshold)
    return df.withColumn("action", F.when(F.col("strength") > 0.7, "keep").when(F.col("strength") > 0.3, "update").otherwise("expire"))


def renew(rows: DataFrame, ids: DataFrame, now: Column, *, created: str) -> DataFrame:
    """Gives rows the time to live of their class again, counted from now."""
    hit = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    fresh = default_ttl_seconds(memory_class())
    return hit.withColumns({"ttl_seconds": F.when(F.col("_hit"), fresh).otherwise(F.col("ttl_seconds")), created: F.when(F.col("_hit"), now).otherwise(F.col(created))}).select(*rows.columns)


def update(rows: DataFrame, changes: DataFrame, *, content: str) -> DataFrame:
    """Overwrites content and class of rows named in ``changes`` (id, content, memory_type; nulls leave as is); a new class resets the time to live."""
    c = changes.select("id", F.col("content").alias("_c"), F.col("memory_type").alias("_m"))
    got = rows.join(c, "id", "left")
    return got.withColumns(
        {
            content: F.coalesce("_c", content),
            "ttl_seconds": F.when(F.col("_m").isNotNull(), default_ttl_seconds(memory_class("_m"))).otherwise(F.col("ttl_seconds")),
            "memory_type": F.coalesce("_m", "memory_type"),
        }
    ).select(*rows.columns)


def mark_for_deletion(rows: DataFrame, condition: Column, now: Column, reason: str = "expired") -> DataFrame:
    """Soft expiry: a flag, its time and reason in the metadata."""
    meta = set_json("metadata", {"marked_for_deletion": F.lit("1"), "marked_at": seconds(now), "reason": F.lit(reason)})
    return rows.withColumn("metadata", F.when(condition, meta).otherwise(F.col("metadata")))


def expire_class(rows: DataFrame, memory: str, now: Column, *, hard: bool = False) -> DataFrame:
    """Drops or marks all rows of a class; patterns are refused."""
    if memory == "pattern":
        raise ValueError("patterns do not expire")
    hit = memory_class() == memory
    return rows.filter(~hit) if hard else mark_for_deletion(rows, hit, now)


def expire(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Removes entities and edges by id, with the links, aliases and edges that hang on a removed entity."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    drop = lambda df, c: df.join(gone, F.col(c) == F.col("_id"), "left_anti")
    return {
        "entities": drop(tables["entities"], "id"),
        "edges": drop(drop(drop(tables["edges"], "id"), "source_id"), "target_id"),
        "aliases": drop(tables["aliases"], "canonical_id"),
        "episode_entities": drop(tables["episode_entities"], "entity_id"),
    }


def cleanup_action(now: Column, *, created: str, grace_seconds: int = GRACE_SECONDS) -> Column:
    """delete, archive or keep: what cleanup does with a row by its own age and flags.

    Marked rows go; facts and experiences older than the life of their class
    plus the grace go; preferences and decisions that old are archived;
    patterns stay. The life is that of the class, not the row's own.
    """
    kind = memory_class()
    old = seconds(now) - seconds(created) > (default_ttl_seconds(kind) + grace_seconds) * 1_000_000
    return (
        F.when(~soft_live(), "delete")
        .when(old & kind.isin("fact", "experience"), "delete")
        .when(old & kind.isin("preference", "decision"), "archive")
        .otherwise("keep")
    )


def cleanup(tables: dict[str, DataFrame], now: Column, *, grace_seconds: int = GRACE_SECONDS) -> dict[str, DataFrame]:
    """Entities and edges with their cleanup ``action``; an edge of a deleted entity is deleted, too.

    One pass per table and one semi-join; ``apply_cleanup`` carries it out.
    """
    ent = tables["entities"].withColumn("action", cleanup_action(now, created="created_at", grace_seconds=grace_seconds))
    gone = ent.filter("action = 'delete'").select(F.col("id").alias("_id")).distinct()
    edges = tables["edges"].withColumn("action", cleanup_action(now, created="recorded_at", grace_seconds=grace_seconds))
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.withColumn("_gone", F.lit(True)), F.col(end) == F.col("_id"), "left")
        edges = edges.withColumn("action", F.when(F.col("_gone"), "delete").otherwise(F.col("action"))).drop("_id", "_gone")
    return {"entities": ent, "edges": edges}


def apply_cleanup(tables: dict[str, DataFrame], now: Column, *, grace_seconds: int = GRACE_SECONDS) -> dict[str, DataFrame]:
    """The tables after cleanup; links and aliases of deleted entities go with them."""
    done = cleanup(tables, now, grace_seconds=grace_seconds)
    gone = done["entities"].filter("action = 'delete'").select(F.col("id").alias("_id")).distinct()
    out = {}
    for name in ("entities", "edges"):
        meta = F.when((F.col("action") == "archive") & ~archived(), set_json("metadata", {"archived": F.lit("true")})).otherwise(F.col("metadata"))
        out[name] = done[name].filter("action <> 'delete'").withColumn("metadata", meta).drop("action")
    out["aliases"] = tables["aliases"].join(gone, F.col("canonical_id") == F.col("_id"), "left_anti")
    out["episode_entities"] = tables["episode_entities"].join(gone, F.col("entity_id") == F.col("_id"), "left_anti")
    return out
