import shutil

import pytest
from pyspark.sql import functions as F

from chronoloom.api import Graph
from chronoloom.sources.store import GraphStore, gold_episodes, thresholds, vocabulary
from chronoloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_store_round_trip(spark, tmp_path):
    s = GraphStore.create(spark, str(tmp_path / "g"))
    with pytest.raises(Exception):
        GraphStore.create(spark, str(tmp_path / "g"))
    with pytest.raises(Exception):
        GraphStore.open(spark, str(tmp_path / "none"))
    src = spark.read.parquet(f"{SF}/aliases.parquet").filter("canonical_id IS NOT NULL AND alias_name IS NOT NULL")
    s.insert_or_ignore("aliases", src)
    n = s.table("aliases").count()
    s.insert_or_ignore("aliases", src)
    assert s.table("aliases").count() == n == src.select("canonical_id", "alias_name").distinct().count()
    s.replace("aliases", s.table("aliases").filter("similarity > 0.9"))
    assert 0 < s.table("aliases").count() < n
    assert s.get("entities", "x").count() == 0


def test_ingest_stream_is_idempotent(spark, tmp_path):
    s = GraphStore.create(spark, str(tmp_path / "g"))
    called = []
    ingest.ingest(s, spark, SF, "edges", after=lambda st, n: called.append(n), every=1)
    ingest.ingest(s, spark, SF, "edges")
    assert s.table("edges").count() == spark.read.parquet(f"{SF}/edges.parquet").select("id").distinct().count()
    assert called


def test_graph_tools(spark, tmp_path):
    g = Graph(spark, str(tmp_path / "g"), create=True)
    eps = spark.createDataFrame(
        [("e1", "HeronRouter depends on lark-cache. PineStore replaced OldStore.", "slack"), ("e2", "HeronRouter depends on iris-cache today.", None), ("e3", None, None)],
        "id string, content string, source string",
    ).withColumn("recorded_at", F.lit("2025-01-01").cast("timestamp"))
    g.add_episodes(eps, at=F.lit("2025-01-02").cast("timestamp"))
    assert {(r.relation, r.fact) for r in g.store.table("edges").collect()} == {
        ("depends_on", "HeronRouter depends_on lark-cache"), ("depends_on", "HeronRouter depends_on iris-cache"), ("replaced", "PineStore replaced OldStore")}
    g.add_episodes(eps, at=F.lit("2025-01-02").cast("timestamp"))
    assert g.store.table("edges").count() == 3 and g.store.table("entities").count() == 5 and g.stats().first().episodes == 3
    assert g.search("heronrouter depends", limit=5).count() == 2
    assert g.get_decision("e1").first().entities == ["HeronRouter", "OldStore", "PineStore", "lark-cache"]
    near = g.traverse(["HeronRouter", "Nobody"], depth=1)
    assert near["nodes"].count() == 3 and near["edges"].count() == 2
    with pytest.raises(KeyError):
        g.traverse(["Nobody"])
    assert g.entity("HeronRouter").count() == 1 and g.entity("HeronRouter", "Database").count() == 0
    g.embed("episodes", "content")
    g.embed("episodes", "content")
    assert g.store.table("embeddings").count() == 2
    vector = g.store.table("embeddings").filter("id = 'e1'").first().embedding
    assert g.find_precedents(vector, limit=1).first().id == "e1" and g.search("heronrouter depends", vector=vector, limit=2).first().id == "e1"
    assert g.list_entities(limit=2, offset=1).count() == 2
    assert g.retrieve_for_context("PineStore", now=F.lit("2025-01-03").cast("timestamp")).count() >= 1
    g.export_graph(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/edges")).count() == 3
    first = g.store.table("entities").filter("name = 'OldStore'").first().id
    g.forget(ids=[first])
    assert g.stats().first().entities == 4
    g.cleanup(now=F.lit("2025-01-03").cast("timestamp"))
    assert g.store.table("entities").count() == 4 and g.store.table("edges").count() == 2
    gone = g.store.table("entities").filter("name = 'HeronRouter'").first().id
    g.forget(ids=[gone], hard=True)
    assert g.store.table("edges").count() == 0
    with pytest.raises(ValueError):
        g.forget(memory="pattern")


def test_contradictions_can_be_read_afterwards(spark, tmp_path):
    """Frames of a call still run after the tables were replaced; the same target is no contradiction."""
    g = Graph(spark, str(tmp_path / "g"), create=True)
    make = lambda i, t: spark.createDataFrame([(i, t, "slack")], "id string, content string, source string").withColumn("recorded_at", F.lit("2025-01-01").cast("timestamp"))
    at = F.lit("2025-01-02").cast("timestamp")
    g.add_episodes(make("e1", "HeronRouter depends on lark-cache."), at=at)
    before = g.store.table("edges")
    got = g.add_episodes(make("e2", "HeronRouter depends on iris-cache."), at=at)
    assert before.count() == 1 and g.store.table("edges").count() == 2
    assert got["contradictions"].count() == 1 and got["edges"].count() == 1 and got["entities"].count() == 1


def test_metadata_and_versions(spark, tmp_path):
    s = GraphStore.create(spark, str(tmp_path / "g"))
    assert s.get_metadata("runs") is None
    for v in ("1", "2"):
        s.set_metadata("runs", v)
    assert s.get_metadata("runs") == "2"
    for n in range(4):
        s.replace("aliases", spark.createDataFrame([(f"a{n}",)], "alias_id string"))
    assert [r.alias_id for r in s.table("aliases").collect()] == ["a3"] and len(s._versions("aliases")) == 2
    shutil.rmtree(tmp_path / "g" / "patterns")  # as in a store of an older version
    again = GraphStore.open(spark, str(tmp_path / "g"))
    assert again.table("aliases").count() == 1 and again.table("patterns").count() == 0
    assert again.get_metadata("schema_version") == "2" and again.migrate() == 0


def test_thresholds(tmp_path):
    (tmp_path / "t.toml").write_text("[thresholds]\nentity = 0.6\n")
    assert thresholds(str(tmp_path / "t.toml"), entity=0.5, relation=0.4) == {"entity": 0.6, "relation": 0.4}
    with pytest.raises(ValueError):
        thresholds(str(tmp_path / "t.toml"), relation=0.4)


def test_learn_and_share(spark, tmp_path):
    g = Graph(spark, str(tmp_path / "g"), create=True)
    g.store.append("entities", spark.createDataFrame([("a", "A", "Service"), ("b", "B", "Database")], "id string, name string, entity_type string"))
    rows = [(f"x{i}", "a", "b", "fixed") for i in range(3)] + [("y", "b", "a", "deprecated")]
    g.store.append("edges", spark.createDataFrame(rows, "id string, source_id string, target_id string, relation string"))
    one = g.learn(agent="me").collect()
    assert [(s.success_count, s.failure_count, s.confidence) for s in one] == [(3, 1, 0.75)]
    g.store.append("edges", spark.createDataFrame([("z", "a", "b", "fixed")], "id string, source_id string, target_id string, relation string"))
    two = g.learn(agent="me").collect()
    assert [s.success_count for s in two] == [4] and g.store.table("skills").count() == 2
    links = [(f"p{i}", x) for i in range(3) for x in ("a", "b")]
    g.store.append("episodes", spark.createDataFrame([(f"p{i}",) for i in range(3)], "id string"))
    g.store.append("episode_entities", spark.createDataFrame(links, "episode_id string, entity_id string"))
    two = g.learn(agent="me", describe=lambda df: df.withColumn("description", F.lit("told"))).collect()
    assert {(r.kind, r.key, r.description) for r in g.patterns().collect()} == {("pair", "A|B", "told")}
    assert g.learn(agent="me").count() == 1 and g.patterns().first().description == "told"
    assert g.skills().count() == 1 and g.skills(every=True).count() == 2
    assert g.skills_for("me").count() == 1 and g.skills_for("you").count() == 0
    g.share_skill(two[0].id)
    assert g.skills_for("you", "Database").first().score >= 0.8


def test_vocabulary_and_gold(spark, tmp_path):
    (tmp_path / "v.toml").write_text('[schema.entities]\nService = "runs"\n[schema.relations.uses]\nhead = ["Service"]\ntail = ["Service", "Database"]\ndescription = "d"\n')
    e, r = vocabulary(spark, str(tmp_path / "v.toml"))
    assert e.count() == 1 and r.count() == 2
    (tmp_path / "g.json").write_text('[{"text": "t", "domain": "d", "expected_entities": [{"name": "n", "entity_type": "x"}], "expected_relations": []}]')
    assert gold_episodes(spark, str(tmp_path / "g.json")).first().expected_entities[0].name == "n"
