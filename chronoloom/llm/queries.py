"""The numbered text problems as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.common import load
from chronoloom.llm.components import groups_by_shared_value
from chronoloom.llm.encode import encode_corpus
from chronoloom.llm.leak import leaked_items
from chronoloom.llm.names import identity_pairs, name_identities
from chronoloom.llm.overlap import cross_split_overlaps, overlap_pairs, overlap_report
from chronoloom.llm.pii import found_texts, gazetteer, personal_spans, redacted
from chronoloom.llm.skeleton import same_look_groups, same_look_pairs


def _overlaps(spark: SparkSession, sf_dir: str):
    data = load(spark, sf_dir, "training_data")
    return cross_split_overlaps(data, id="example_id", text="text", split="split", source="source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples that recur in an evaluation split, see ``cross_split_overlaps``."""
    pairs = overlap_pairs(*_overlaps(spark, sf_dir))
    return pairs.select(F.col("a").alias("example_id_a"), F.col("b").alias("example_id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps counted per evaluation split and source."""
    return overlap_report(*_overlaps(spark, sf_dir))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = gazetteer(load(spark, sf_dir, "entities"), name="name", kind="entity_type")
    return personal_spans(load(spark, sf_dir, "episodes"), id="id", text="content", names=names)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the episodes, see ``personal_spans``."""
    found = found_texts(_personal(spark, sf_dir), id="id")
    return found.select(F.col("id").alias("episode_id"), "kind", "found_text")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episodes with typed placeholders in place of personal data."""
    return redacted(load(spark, sf_dir, "episodes"), _personal(spark, sf_dir), id="id", text="content")


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_identities(
        load(spark, sf_dir, "entities"), load(spark, sf_dir, "aliases"),
        entity_id="id", entity_name="name", entity_type="entity_type", alias_id="alias_id", canonical_id="canonical_id", alias_name="alias_name",
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that name the same person or organisation, see ``name_identities``."""
    return identity_pairs(_identities(spark, sf_dir))


def p4_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record with the identity it names."""
    return _identities(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of entities tied by shared alias names, see ``groups_by_shared_value``."""
    a = load(spark, sf_dir, "aliases")
    name = F.lower(F.trim("alias_name"))
    named = a.select("canonical_id", F.when(name != "", name).alias("name"))
    return groups_by_shared_value(named, node="canonical_id", value="name")


P5_SQL = """
WITH RECURSIVE l AS (
  SELECT DISTINCT canonical_id AS id, lower(trim(alias_name)) AS name FROM aliases
  WHERE canonical_id IS NOT NULL AND trim(alias_name) <> ''
), hub AS (
  SELECT id, min(id) OVER (PARTITION BY name) AS h FROM l
), e AS (
  SELECT id AS a, h AS b FROM hub WHERE id <> h UNION SELECT h, id FROM hub WHERE id <> h
), reach AS (
  SELECT a AS id, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id WHERE reach.r < e.b
), least AS (
  SELECT id, min(r) AS g FROM reach GROUP BY id
)
SELECT id AS canonical_id, g AS group_id FROM least
"""


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain passages of evaluation items, see ``leaked_items``."""
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")
    return leaked_items(docs, items, id="doc_id", text="text", item_id="item_id", item_text="text").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose texts differ but look the same, see ``same_look_pairs``."""
    return same_look_pairs(load(spark, sf_dir, "documents"), id="doc_id", text="text")


def p9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as membership: each document with the group of those that look like it, see ``same_look_groups``."""
    return same_look_groups(load(spark, sf_dir, "documents"), id="doc_id", text="text")


#: Where the public vocabularies lie; a path all of the driver's own, Spark hands the file on.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, see ``encode_corpus``."""
    return encode_corpus(load(spark, sf_dir, "documents"), id="doc_id", text="text", vocabulary=VOCABULARY)


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_identities": p4_identities, "p2_found": p2_found, "p2_report": p2_report, "p7_ids": p7_ids, "p5_found": p5_found, "p8_found": p8_found, "p9_found": p9_found, "p9_groups": p9_groups}
SQL = {"p5_found": P5_SQL}
