"""The numbered general problems as registered queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.common import load, micros
from chronoloom.operators.asof import as_known
from chronoloom.operators.intervals import periods_and_gaps

#: What stands for an open end of an edge (9999-12-31 in microseconds since 1970).
OPEN_END = 253402214400000000


def _known(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return as_known(
        load(spark, sf_dir, "recall_log"),
        load(spark, sf_dir, "edges"),
        event_id="recall_id",
        event_keys=["entity_id", "relation"],
        event_time="recalled_at",
        fact_keys=["source_id", "relation"],
        fact_id="id",
        **how,
    ).select("recall_id", F.col("id").alias("edge_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge of its entity and relation that each recall could know, see ``as_known``."""
    return _known(spark, sf_dir)


def p1_small_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two changes a period, so that nearly all recalls are answered from a snapshot and a short log."""
    return _known(spark, sf_dir, changes_per_period=2)


P1_SQL = """
SELECT recall_id, edge_id FROM (
  SELECT r.recall_id, e.id AS edge_id,
         row_number() OVER (PARTITION BY r.recall_id ORDER BY e.recorded_at DESC, e.valid_from DESC NULLS LAST, e.id DESC) AS n
  FROM (SELECT DISTINCT recall_id, entity_id, relation, recalled_at FROM recall_log) r
  JOIN (SELECT DISTINCT id, source_id, relation, valid_from, valid_until, recorded_at FROM edges) e
    ON e.source_id = r.entity_id AND e.relation = r.relation AND e.recorded_at <= r.recalled_at
   AND (e.valid_from IS NULL OR e.valid_from <= r.recalled_at)
   AND (e.valid_until IS NULL OR e.valid_until > r.recalled_at)
) WHERE n = 1
"""


def _periods(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    edges = load(spark, sf_dir, "edges").select(
        "source_id",
        "relation",
        F.coalesce(micros("valid_from"), F.lit(0)).alias("s"),
        F.coalesce(micros("valid_until"), F.lit(OPEN_END)).alias("e"),
    )
    return periods_and_gaps(edges, keys=["source_id", "relation"], start="s", end="e", **how)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of the edges of each source and relation, see ``periods_and_gaps``."""
    return _periods(spark, sf_dir)


def p6_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards of eight intervals, so that many keys are clipped, merged by shard and stitched."""
    return _periods(spark, sf_dir, rows_per_shard=8)


P6_SQL = f"""
WITH iv AS (
  SELECT source_id, relation,
         coalesce(epoch_us(valid_from), 0) AS s, coalesce(epoch_us(valid_until), {OPEN_END}) AS e
  FROM edges
), m AS (
  SELECT *, max(e) OVER (PARTITION BY source_id, relation ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
  FROM iv WHERE s < e
), g AS (
  SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END)
            OVER (PARTITION BY source_id, relation ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp
  FROM m
), p AS (
  SELECT source_id, relation, grp, min(s) AS s, max(e) AS e FROM g GROUP BY ALL
), n AS (
  SELECT *, lead(s) OVER (PARTITION BY source_id, relation ORDER BY s) AS nxt FROM p
)
SELECT source_id, relation, 'period' AS kind, s AS from_us, e AS until_us FROM n
UNION ALL
SELECT source_id, relation, 'gap', e, nxt FROM n WHERE nxt IS NOT NULL
"""

QUERIES = {"p1_found": p1_found, "p1_small_periods": p1_small_periods, "p6_found": p6_found, "p6_small_shards": p6_small_shards}
SQL = {"p1_found": P1_SQL, "p1_small_periods": P1_SQL, "p6_found": P6_SQL, "p6_small_shards": P6_SQL}
