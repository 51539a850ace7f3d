import random

import pytest
from compare import compare

from chronoloom.plans import catalog
from chronoloom.streaming import ingest

SCHEMA = "id string, source_id string, relation string, target_id string, recorded_at timestamp"


def edges(spark, n):
    r = random.Random(5)
    rows = [(f"e{i:04}", r.choice(["hot", "hot", "hot", f"s{i % 7}"]), "uses", f"t{r.randint(0, 3)}", r.randint(0, n // 2)) for i in range(n)]
    r.shuffle(rows)
    rows += rows[:20]
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "bigint")).withColumn("recorded_at", ingest.F.timestamp_seconds("recorded_at"))


def test_contradictions_of_many_files_in_any_order(spark, tmp_path):
    """More files than a micro-batch takes, so that edges come batches late."""
    edges(spark, 600).repartition(20).write.parquet(f"{tmp_path}/edges.parquet")
    assert len(list(tmp_path.glob("edges.parquet/*.parquet"))) == 20
    assert compare(spark, catalog.QUERIES["stream_contradictions"], catalog.SQL["stream_contradictions"], str(tmp_path)) > 100


def test_contradictions_do_not_depend_on_the_shards(spark, tmp_path):
    edges(spark, 600).write.parquet(f"{tmp_path}/edges.parquet")
    got = [set(ingest.contradictions(ingest.stream_table(spark, str(tmp_path), "edges"), rows_per_shard=n).collect()) for n in (200_000, 40)]
    assert got[0] == got[1] and len(got[0]) > 100
    (tmp_path / "none").mkdir()
    edges(spark, 1).limit(0).write.parquet(f"{tmp_path}/none/edges.parquet")
    assert ingest.contradictions(ingest.stream_table(spark, f"{tmp_path}/none", "edges")).count() == 0


def split(spark, tmp_path, name):
    """A table in six files in no order of time, some rows in two of them, and a stream that takes one file a batch."""
    df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(6)
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert len(list((tmp_path / f"{name}.parquet").glob("*.parquet"))) == 6
    return str(tmp_path)


@pytest.mark.parametrize("query,name", [("stream_event_windows", "events"), ("stream_sessions", "events"), ("stream_links", "episode_entities"), ("stream_contradictions", "edges")])
def test_streams_over_several_batches(spark, tmp_path, monkeypatch, query, name):
    sf, plain = split(spark, tmp_path, name), ingest.stream_table
    monkeypatch.setattr(ingest, "stream_table", lambda s, d, n, files_per_batch=None: plain(s, d, n, files_per_batch=1))
    assert compare(spark, catalog.QUERIES[query], catalog.SQL[query], sf) > 10


def test_closed_windows_and_keys_leave_the_state(spark, tmp_path):
    """Rows behind the watermark are dropped, and with them the state of their window or key."""
    rows = [("a", 1, 0), ("b", 4, 86_400 * 40), ("c", 3, 86_400 * 41), ("a", 8, 0), ("a", 2, 86_400 * 45)]  # a watermark drops rows from the next batch but one
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k string, v bigint, s bigint").withColumn("ts", ingest.F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    read = lambda: spark.readStream.schema("k string, v bigint, s bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    got = ingest.collected(ingest.windows(read(), time="ts", by=["k"], value="v", late="2 days"), "w", keys=["start_us", "k"]).collect()
    assert {(r.k, r.total) for r in got} == {("a", 1), ("a", 2), ("b", 4), ("c", 3)}
    q = ingest.run_once(ingest.first_links(read(), keys=["k"], time="ts"), f"{tmp_path}/out", checkpoint=f"{tmp_path}/check")
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a", "b", "c"}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
