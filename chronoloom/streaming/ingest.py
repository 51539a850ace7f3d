"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from chronoloom.common import scratch_root, table, until_exit
from chronoloom.sources.store import GraphStore


def stream_table(spark: SparkSession, sf_dir: str, name: str, *, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream; new files of the same name or folder are further input."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def run_once(df: DataFrame, path: str, *, checkpoint: str, mode: str = "append", each: Callable | None = None) -> StreamingQuery:
    """Runs a stream over all input there is, to Parquet at ``path`` or through ``each`` (batch, number), and waits for its end."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()
    q.awaitTermination()
    return q


def windows(events: DataFrame, *, time: str, by: list[str], value: str, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Count and sum per window and key, with a watermark for late rows."""
    ts = F.col(time).cast("timestamp")
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    out = events.withColumn("_ts", ts).withWatermark("_ts", late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.unix_micros("window.start").alias("start_us"), *by, "n", "total")


def sessions(events: DataFrame, *, time: str, by: list[str], gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Rows of a key with no pause longer than ``gap``."""
    out = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    out = out.groupBy(F.session_window("_ts", gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), *by, "n")


def first_links(links: DataFrame, *, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Each key once a span of ``late``: insert-or-ignore over a stream; the state of a key is dropped when the watermark has passed it.

    Keys that may come again after any time are ``landed`` instead, whose state is the table.
    """
    return links.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


def landed(df: DataFrame, name: str) -> DataFrame:
    """All distinct rows of a stream's present input, as a table in the shared folder; a batch that runs again replaces its own files."""
    spark = df.sparkSession
    base = until_exit(spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    spark.createDataFrame([], df.schema).write.parquet(base + "/out/batch=-1")  # a stream without input has no batch
    run_once(df, "", checkpoint=base + "/check", each=lambda b, n: b.distinct().write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    return spark.read.schema(df.schema).parquet(base + "/out").select(*df.columns).distinct()


def contradictions(edges: DataFrame, *, rows_per_shard: int = 200_000) -> DataFrame:
    """Edges of a stream that name another target than the edge recorded before them for their source and relation.

    The stream's edges are landed first, so a row counts at its place in time
    whatever micro-batch brings it; ties in time go by id, repeats count once.
    Rows are cut into ranges of (source, relation, time, id), which spreads a
    hot key; predecessors are looked up within a range, and the last row of a
    key in one range is stitched to its first row in the next that has any.
    """
    rows = edges.filter("id IS NOT NULL AND target_id IS NOT NULL AND recorded_at IS NOT NULL AND source_id IS NOT NULL AND relation IS NOT NULL").select(
        "source_id", "relation", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("recorded_us"), "id", F.col("target_id").alias("target")
    )
    rows = landed(rows, "edges")
    shards = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_per_shard))
    order = ["source_id", "relation", "recorded_us", "id", "target"]
    rows = table(rows.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()), "edges")
    key, at = ["source_id", "relation"], ["recorded_us", "id", "target"]
    row = F.struct(*at)
    w = Window.partitionBy("shard", *key).orderBy(*at)
    within = rows.withColumn("old", F.lag(F.struct("id", "target")).over(w)).filter("old IS NOT NULL")
    # a key in several ranges has one row for each here, and there are no more such keys than ranges
    ends = rows.groupBy("shard", *key).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    ends = ends.withColumn("old", F.lag("last").over(Window.partitionBy(*key).orderBy("shard"))).filter("old IS NOT NULL")
    stitched = ends.select(*key, "first.*", F.struct("old.id", "old.target").alias("old"))
    both = within.select(*key, *at, "old").unionByName(stitched)
    return both.filter("old.target <> target").select(*key, F.col("id").alias("new_id"), F.col("old.id").alias("existing_id"), "recorded_us")


def ingest(store: GraphStore, spark: SparkSession, sf_dir: str, name: str, *, after: Callable[[GraphStore, int], None] | None = None, every: int = 50) -> StreamingQuery:
    """Streams a table into a store, each row once; ``after`` runs every ``every`` micro-batches (learning, cleanup).

    A batch that is run again after a failure changes nothing, because rows
    that are there are ignored.
    """
    def each(batch: DataFrame, number: int) -> None:
        store.insert_or_ignore(name, batch)
        if after and number % every == every - 1:
            after(store, number)

    return run_once(stream_table(spark, sf_dir, name), "", checkpoint=f"{store.path}/_checkpoints/{name}", each=each)


def collected(df: DataFrame, name: str, *, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over its present input and gives the result as a table in the shared folder.

    With ``keys`` the stream runs in update mode: each micro-batch writes the
    rows it changed and the last of each key counts, so windows that no
    watermark has closed yet are there, too, and closed ones leave the state.
    Without them it runs in complete mode (sessions know no other).
    """
    spark = df.sparkSession
    base = until_exit(spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    if keys is None:
        run_once(df, "", checkpoint=base + "/check", mode="complete", each=lambda b, n: b.write.mode("overwrite").parquet(base + "/out"))
        return spark.read.schema(df.schema).parquet(base + "/out")
    rest = [c for c in df.columns if c not in keys]
    spark.createDataFrame([], df.schema).write.parquet(base + "/out/batch=-1")
    run_once(df, "", checkpoint=base + "/check", mode="update", each=lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    got = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(base + "/out")
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
