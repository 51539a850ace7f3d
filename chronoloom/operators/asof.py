"""Attributes as known at event time: periodic snapshots plus change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.common import keyed_side, micros

NEVER = -(2**63)
ALWAYS = 2**63 - 1
MOST_BITS = 20


def as_known(
    events: DataFrame,
    facts: DataFrame,
    *,
    event_id: str,
    event_keys: list[str],
    event_time: str,
    fact_keys: list[str],
    fact_id: str,
    valid_from: str = "valid_from",
    valid_until: str = "valid_until",
    recorded_at: str = "recorded_at",
    changes_per_period: int = 64,
) -> DataFrame:
    """For each event the fact that held, and was already on record, at its time.

    A fact counts for an event at t if ``valid_from`` is null or <= t,
    ``valid_until`` null or > t and ``recorded_at`` <= t; of several the one
    recorded last wins, then the latest ``valid_from`` (null is earliest), then
    the greatest id.

    A fact thus is in effect in [max(valid_from, recorded_at), valid_until).
    Each key with more than ``changes_per_period`` facts gets a grid of equal
    periods over the time its events span, one period for about that many
    facts. The snapshot of a period holds the winner among the facts in effect
    through all of it; facts that begin or end inside the period are its
    change log. An event meets the one snapshot row of its period and replays
    that period's changes only. Snapshots come from dyadic blocks of periods,
    so a fact adds at most two rows a level however long it holds. Keys with
    few facts have one period without a snapshot. Key and period together are
    the shuffle key, hence a key with a third of all rows is spread; the grid
    itself is joined by ``keyed_side``, which spreads it, too.

    Result: ``event_id``, ``fact_id``, one row for each event that has such a
    fact. Events with a null key or time, facts with a null key, a null
    ``recorded_at`` or an end not after their start match nothing. Repeated
    rows of either side change nothing (the winner is a maximum). Empty inputs
    give an empty result. Other columns of either side are ignored, whatever
    their names.
    """
    keys = [f"k{i}" for i in range(len(event_keys))]
    ev = events.select(
        F.col(event_id).alias("event"), micros(event_time).alias("t"), *(F.col(c).alias(k) for c, k in zip(event_keys, keys))
    ).dropna(subset=["t", *keys])
    vf, rec = micros(valid_from), micros(recorded_at)
    ch = (
        facts.select(
            *(F.col(c).alias(k) for c, k in zip(fact_keys, keys)),
            F.greatest(F.coalesce(vf, F.lit(NEVER)), rec).alias("a"),
            F.coalesce(micros(valid_until), F.lit(ALWAYS)).alias("b"),
            F.struct(rec.alias("rec"), F.coalesce(vf, F.lit(NEVER)).alias("vf"), F.col(fact_id).alias("id")).alias("fact"),
        )
        .dropna(subset=keys)
        .filter("fact.rec IS NOT NULL AND a < b")
    )

    # The grid of each key with many facts; lo and hi are the first and last event.
    many = ch.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > changes_per_period)
    span = ev.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("m"))
    bits = F.least(F.ceil(F.log2(F.col("n") / changes_per_period)), F.lit(MOST_BITS)).cast("int")
    grid = many.join(span, keys).select(*keys, "n", "m", "lo", "hi", bits.alias("bits"))
    grid = keyed_side(grid.withColumn("width", F.expr("(hi - lo) div shiftleft(1L, bits) + 1")), keys)

    cell = "(({} - lo) div width)"
    # A key without a grid has one period: all its facts are changes of period 0.
    g = grid(ch, "n").withColumns(
        {
            "c0": F.expr(f"CASE WHEN lo IS NULL THEN 0L WHEN a > hi THEN NULL WHEN a <= lo THEN -1L ELSE {cell.format('a')} END"),
            "c1": F.expr(f"CASE WHEN lo IS NULL THEN 0L WHEN b <= lo THEN NULL WHEN b > hi THEN shiftleft(1L, bits) ELSE {cell.format('b')} END"),
        }
    )
    g = g.filter("c0 IS NOT NULL AND c1 IS NOT NULL")
    # Changes: a fact is listed in the period where it begins and in the one where it ends.
    log = g.select(
        *keys,
        "a",
        "b",
        "fact",
        F.explode(F.expr("array_distinct(filter(array(c0, c1), c -> c >= 0 AND (lo IS NULL OR c < shiftleft(1L, bits))))")).alias("cell"),
    )
    # Snapshots: periods c0+1 .. c1-1 are covered whole; they are cut into dyadic blocks,
    # the winner of each block is found, and each period takes the best of its blocks.
    whole = g.filter("lo IS NOT NULL AND c1 - c0 > 1").select(
        *keys, "fact", F.expr("c0 + 1").alias("l"), F.col("c1").alias("r"), F.explode(F.expr("sequence(0, bits)")).alias("level")
    )
    l, r = "((l + shiftleft(1L, level) - 1) div shiftleft(1L, level))", "(r div shiftleft(1L, level))"
    blocks = whole.select(
        *keys,
        "fact",
        "level",
        F.explode(F.expr(f"filter(array(IF({l} % 2 = 1, {l}, NULL), IF({r} % 2 = 1, {r} - 1, NULL)), x -> x IS NOT NULL AND {l} < {r})")).alias("block"),
    )
    best = blocks.groupBy(*keys, "level", "block").agg(F.max("fact").alias("fact"))
    snapshot = (
        best.select(
            *keys, "fact", F.explode(F.expr("sequence(shiftleft(block, level), shiftleft(block + 1, level) - 1)")).alias("cell")
        )
        .groupBy(*keys, "cell")
        .agg(F.max("fact").alias("fact"))
        .select(*keys, F.lit(NEVER).alias("a"), F.lit(ALWAYS).alias("b"), "fact", "cell")
    )
    at = grid(ev, "m").select(
        "event", "t", *keys, F.expr(f"IF(lo IS NULL, 0L, {cell.format('t')})").alias("cell")
    )
    known = log.unionByName(snapshot)
    return (
        at.join(known, [*keys, "cell"])
        .filter("a <= t AND t < b")
        .groupBy("event")
        .agg(F.max("fact").alias("fact"))
        .select(F.col("event").alias(event_id), F.col("fact.id").alias(fact_id))
    )
