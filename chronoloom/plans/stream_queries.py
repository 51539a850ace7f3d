"""Registered queries that run as streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.plans.base import query
from chronoloom.streaming import ingest


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_event_windows(spark, sf_dir):
    """Events per day and type, as a stream with a watermark."""
    got = ingest.windows(ingest.stream_table(spark, sf_dir, "events", files_per_batch=8), time="ts", by=["event_type"], value="value", late="3650 days")
    return ingest.collected(got, "windows", keys=["start_us", "event_type"]).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, g""")
def stream_sessions(spark, sf_dir):
    """Sessions of users with pauses of six hours at most."""
    got = ingest.sessions(ingest.stream_table(spark, sf_dir, "events", files_per_batch=8), time="ts", by=["user_id"], gap="6 hours", late="3650 days")
    return ingest.collected(got, "sessions")


@query("SELECT DISTINCT episode_id, entity_id FROM episode_entities")
def stream_links(spark, sf_dir):
    """Links of episodes and entities, each once, whatever micro-batch brings them."""
    links = ingest.stream_table(spark, sf_dir, "episode_entities", files_per_batch=8).select("episode_id", "entity_id")
    return ingest.landed(links, "links")


@query("""WITH e AS (SELECT DISTINCT id, source_id, relation, target_id, recorded_at FROM edges WHERE recorded_at IS NOT NULL AND source_id IS NOT NULL AND relation IS NOT NULL),
l AS (SELECT *, lag(id) OVER w AS pid, lag(target_id) OVER w AS pt FROM e WINDOW w AS (PARTITION BY source_id, relation ORDER BY recorded_at, id))
SELECT source_id, relation, id AS new_id, pid AS existing_id, epoch_us(recorded_at) AS recorded_us FROM l WHERE pt <> target_id""")
def stream_contradictions(spark, sf_dir):
    """Edges that contradict the one recorded before them, in whatever order the stream's files bring them."""
    return ingest.contradictions(ingest.stream_table(spark, sf_dir, "edges", files_per_batch=8))
