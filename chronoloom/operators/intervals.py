"""Continuous periods and gaps of overlapping intervals: a two-level merge over time shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.common import keyed_side

MOST_SHARDS = 4096


def _merge(df: DataFrame, by: list[str]) -> DataFrame:
    """Merges the intervals [s, e) of each group; adds ``nxt``, the start of the next one, and ``first``."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    whole = Window.partitionBy(*by)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumns({"m": F.max("e").over(before), "top": F.max("e").over(whole)})
        .filter("m IS NULL OR s > m")
        .withColumns({"e": F.coalesce(F.lead("m").over(w), F.col("top")), "nxt": F.lead("s").over(w), "first": F.col("m").isNull()})
        .select(*by, "s", "e", "nxt", "first")
    )


def periods_and_gaps(
    df: DataFrame,
    *,
    keys: list[str],
    start: str,
    end: str,
    rows_per_shard: int = 2000,
) -> DataFrame:
    """Merges half-open intervals per key and lists the gaps between them.

    ``start`` and ``end`` are bigint columns. Result: the keys, ``kind``
    ('period' or 'gap'), ``from_us``, ``until_us``. Intervals that overlap or
    touch form one period; a gap lies between two consecutive periods. Rows
    with a null bound or an end not after their start are ignored; repeated
    rows change nothing; null keys form groups of their own; an empty input
    gives an empty result; other columns are ignored.

    Two levels: a key with more than ``rows_per_shard`` intervals is cut into
    equal time shards (about that many intervals each, at most
    ``MOST_SHARDS``). An interval is clipped to the shards where it begins and
    ends; the shards in between that it covers whole are aggregated to ranges
    before they are spread, so long intervals don't multiply. Every shard is
    merged on its own. Pieces with neighbours on both sides in their shard are
    final, gaps inside a shard too; only the first and last piece of a shard
    go on to the stitching, at most two rows a shard, which joins what touches
    across boundaries.
    """
    k = [f"k{i}" for i in range(len(keys))]
    # Nulls are grouped by window and aggregate alike; joins use null-safe equality.
    iv = df.select(*(F.col(c).alias(x) for c, x in zip(keys, k)), F.col(start).alias("s"), F.col(end).alias("e")).filter("s < e")
    grid = (
        iv.groupBy(*k)
        .agg(
            F.count("*").alias("n"), F.min("s").alias("lo"), F.max("e").alias("hi"),
            F.max("s").alias("s1"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"),
        )
        .filter(F.col("n") > rows_per_shard)
        .withColumn("shards", F.least(F.ceil(F.col("n") / rows_per_shard), F.lit(MOST_SHARDS)))
        # the middle of the starts, so that a few far ones don't empty the grid
        .withColumn("g0", F.expr("greatest(lo, cast(mean - 2.5 * sd AS bigint))"))
        .withColumn("width", F.expr("greatest(1L, (least(s1, cast(mean + 2.5 * sd AS bigint)) - g0) div shards)"))
        .select(*k, "n", "lo", "hi", "shards", "g0", "width")
    )
    grid = keyed_side(grid, k)
    shard = "least(greatest(({} - g0) div width, 0L), shards - 1)"
    left = "IF({0} = 0, lo, g0 + {0} * width)"
    right = "IF({0} = shards - 1, hi, g0 + ({0} + 1) * width)"
    g = grid(iv, "n").withColumns(
        {"c0": F.expr(f"IF(shards IS NULL, 0L, {shard.format('s')})"), "c1": F.expr(f"IF(shards IS NULL, 0L, {shard.format('(e - 1)')})")}
    )
    few = g.filter("shards IS NULL").select(*k, F.lit(None).cast("bigint").alias("shard"), "s", "e")
    cut = g.filter("shards IS NOT NULL").withColumns(
        {"f0": F.expr(f"IF(s <= {left.format('c0')}, c0, c0 + 1)"), "f1": F.expr(f"IF(e >= {right.format('c1')}, c1, c1 - 1)")}
    )
    # c0 below f0: a piece in the first shard; c1 above f1: one in the last. Both the same shard: one piece.
    pieces = cut.select(
        *k,
        F.explode(
            F.expr(
                f"""filter(array(
                IF(c0 < f0, named_struct('shard', c0, 's', s, 'e', least(e, {right.format('c0')})), NULL),
                IF(c1 > f1 AND NOT (c0 = c1 AND c0 < f0), named_struct('shard', c1, 's', greatest(s, {left.format('c1')}), 'e', e), NULL)),
                x -> x IS NOT NULL)"""
            )
        ).alias("p"),
    ).select(*k, "p.shard", "p.s", "p.e")
    w = Window.partitionBy(*k).orderBy("f0").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        cut.filter("f0 <= f1")
        .groupBy(*k, "f0", "shards", "lo", "hi", "g0", "width")
        .agg(F.max("f1").alias("f1"))
        .withColumn("f0", F.greatest(F.col("f0"), F.coalesce(F.max("f1").over(w) + 1, F.col("f0"))))
        .filter("f0 <= f1")
        .withColumn("shard", F.explode(F.sequence("f0", "f1")))
        .select(*k, "shard", F.expr(left.format("shard")).alias("s"), F.expr(right.format("shard")).alias("e"))
    )
    local = _merge(few.unionByName(pieces).unionByName(full), [*k, "shard"])
    edge = F.col("shard").isNotNull() & (F.col("first") | F.col("nxt").isNull())
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("from_us"), F.col(b).alias("until_us"))
    inner = local.select(
        *k,
        F.explode(
            F.filter(
                F.array(F.when(~edge, row("period", "s", "e")), F.when(F.col("nxt").isNotNull(), row("gap", "e", "nxt"))),
                lambda x: x.isNotNull(),
            )
        ).alias("r"),
    )
    # Stitching: the pieces are disjoint, so lag alone tells whether they touch.
    w = Window.partitionBy(*k).orderBy("s")
    ends = local.filter(edge).withColumns({"pe": F.lag("e").over(w), "ps": F.lag("shard").over(w), "top": F.max("e").over(Window.partitionBy(*k))})
    ends = ends.filter("pe IS NULL OR s > pe").withColumn("e", F.coalesce(F.lead("pe").over(w), F.col("top")))
    outer = ends.select(
        *k,
        F.explode(
            F.filter(
                F.array(row("period", "s", "e"), F.when(F.col("pe").isNotNull() & (F.col("ps") != F.col("shard")), row("gap", "pe", "s"))),
                lambda x: x.isNotNull(),
            )
        ).alias("r"),
    )
    return inner.unionByName(outer).select(*(F.col(x).alias(c) for c, x in zip(keys, k)), "r.kind", "r.from_us", "r.until_us")
