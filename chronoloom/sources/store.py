"""The graph on disk: one Parquet folder a table, with appends that ignore or merge what is there."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "episodes": "id string, content string, source string, recorded_at timestamp, metadata string, compression_id string, memory_type string",
    "entities": "id string, name string, entity_type string, summary string, created_at timestamp, metadata string, memory_type string, ttl_seconds bigint, usage_count int, last_recalled_at timestamp",
    "edges": "id string, source_id string, target_id string, relation string, fact string, valid_from timestamp, valid_until timestamp, recorded_at timestamp, confidence double, episode_id string, metadata string, memory_type string, ttl_seconds bigint, usage_count int, last_recalled_at timestamp",
    "episode_entities": "episode_id string, entity_id string, span_start bigint, span_end bigint",
    "aliases": "alias_id string, canonical_id string, alias_name string, similarity double",
    "skills": "id string, name string, description string, trigger_condition string, action string, success_count bigint, failure_count bigint, confidence double, superseded_by string, created_at timestamp, entity_types array<string>, scope string, created_by_agent string",
    "embeddings": "id string, embedding array<float>",
    "patterns": "id string, kind string, key string, entity_types array<string>, episodes bigint, confidence double, description string, created_at timestamp",
    "metadata": "key string, value string, written_at timestamp",
}
#: Number of the set of tables and columns above; stores of an older one get what they lack when they are opened.
SCHEMA_VERSION = 2
#: What makes a row of a table the same row.
KEYS = {"episode_entities": ["episode_id", "entity_id"], "aliases": ["canonical_id", "alias_name"]}


class GraphStore:
    """Tables under one path of any file system that Spark knows.

    Every table is a folder of numbered versions, each a folder of Parquet
    files; the highest complete one counts. ``append`` adds files to it;
    ``replace`` writes the next one and keeps the one before it, so there
    always is a whole table and frames read before a rewrite still run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, exist_ok: bool = False) -> GraphStore:
        """Empty tables at ``path``; fails if there are some unless ``exist_ok``."""
        store = cls(spark, path)
        for name, ddl in SCHEMAS.items():
            there = store._versions(name)
            if there and not exist_ok:
                raise FileExistsError(f"{store.path} has a table {name}")
            if not there:
                store.empty(name, ddl).write.parquet(f"{store.path}/{name}/0")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphStore:
        """An existing store, with the tables added that it lacks; fails if there is none. Columns that its files lack read as null."""
        store = cls(spark, path)
        store.at("episodes")
        store.migrate()
        return store

    def migrate(self) -> int:
        """Brings a store to the present ``SCHEMA_VERSION``; returns the number of tables that were added. A second call adds none."""
        missing = [n for n in SCHEMAS if not self._versions(n)]
        for name in missing:
            self.empty(name).write.parquet(f"{self.path}/{name}/0")
        if self.get_metadata("schema_version") != str(SCHEMA_VERSION):
            self.set_metadata("schema_version", str(SCHEMA_VERSION))
        return len(missing)

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self, name: str) -> list[int]:
        """The numbers of the table's complete versions."""
        fs, path = self._folder(name)
        if not fs.exists(path):
            return []
        got = [x.getPath() for x in fs.listStatus(path)]
        child = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()) for p in got if p.getName().isdigit() and fs.exists(child(p, "_SUCCESS")))

    def at(self, name: str) -> str:
        """Where the table's present version lies."""
        there = self._versions(name)
        if not there:
            raise FileNotFoundError(f"{self.path} has no table {name}")
        return f"{self.path}/{name}/{there[-1]}"

    def empty(self, name: str, ddl: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([], ddl or SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.at(name)) if name in SCHEMAS else self.spark.read.parquet(self.at(name))

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in ("episodes", "entities", "edges", "aliases", "episode_entities")}

    def get(self, name: str, id: str) -> DataFrame:
        """A row by id; the filter reaches the Parquet scan."""
        return self.table(name).filter(F.col("id") == id)

    def shaped(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` with the table's columns in order and type; absent ones are null."""
        want = self.empty(name).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))

    def append(self, name: str, df: DataFrame) -> None:
        self.shaped(name, df).write.mode("append").parquet(self.at(name))

    def insert_or_ignore(self, name: str, df: DataFrame) -> None:
        """Appends rows whose key isn't there yet, each key once."""
        key = KEYS.get(name, ["id"])
        new = self.shaped(name, df).dropDuplicates(key).join(self.table(name).select(*key).distinct(), key, "left_anti")
        new.write.mode("append").parquet(self.at(name))

    def replace(self, name: str, df: DataFrame) -> None:
        """Rewrites a table, also from frames that read it: the new version counts once it is complete, all but the last one before it go."""
        there = self._versions(name)
        self.shaped(name, df).write.mode("overwrite").parquet(f"{self.path}/{name}/{there[-1] + 1}")
        fs, path = self._folder(name)
        for v in there[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, str(v)), True)

    def get_metadata(self, key: str) -> str | None:
        """A value of the store's own, the last that was set."""
        row = self.table("metadata").filter(F.col("key") == key).agg(F.max_by("value", "written_at").alias("v")).first()
        return row.v

    def set_metadata(self, key: str, value: str) -> None:
        self.append("metadata", self.spark.createDataFrame([(key, value)], "key string, value string").withColumn("written_at", F.current_timestamp()))

    def export(self, path: str, *, entity_type: str | None = None, kind: str = "json") -> None:
        """Writes entities (of a type), the edges that touch them and their episodes."""
        from chronoloom.functions.columns import soft_live
        from chronoloom.operators.graph import touching

        ents = self.table("entities").filter(soft_live())
        ents = ents.filter(F.col("entity_type") == entity_type) if entity_type else ents
        edges = touching(self.table("edges"), ents)
        eps = self.table("episodes").join(edges.select(F.col("episode_id").alias("id")), "id", "left_semi")
        for name, df in (("entities", ents), ("edges", edges), ("episodes", eps)):
            df.write.mode("overwrite").format(kind).save(f"{path}/{name}")


def vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(type, description) and (relation, head, tail, description) of a TOML file of entity types and relations.

    Reads ``[schema.entities]`` (name = description) and ``[schema.relations.x]``
    with ``head``, ``tail`` and ``description``, with or without the outer table.
    """
    d = tomllib.loads(Path(path).read_text())
    d = d.get("schema", d)
    ents = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in d.get("entities", {}).items()]
    rels = [(k, h, t, v.get("description", "")) for k, v in d.get("relations", {}).items() for h in v.get("head", [None]) for t in v.get("tail", [None])]
    return spark.createDataFrame(ents, "type string, description string"), spark.createDataFrame(rels, "relation string, head string, tail string, description string")


def thresholds(path: str, **defaults: float) -> dict[str, float]:
    """Numbers of the table ``[thresholds]`` (or the whole) of a TOML file over ``defaults``; unknown names and other types are refused."""
    d = tomllib.loads(Path(path).read_text())
    own = d.get("thresholds", {k: v for k, v in d.items() if not isinstance(v, dict)})
    wrong = [k for k, v in own.items() if k not in defaults or isinstance(v, bool) or not isinstance(v, (int, float))]
    if wrong:
        raise ValueError(f"no thresholds: {', '.join(wrong)}")
    return defaults | {k: float(v) for k, v in own.items()}


GOLD = "domain string, source string, text string, expected_entities array<struct<name: string, entity_type: string, span_start: bigint, span_end: bigint>>, expected_relations array<struct<head: string, relation: string, tail: string>>"


def gold_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Labelled episodes for scoring extraction, a JSON array of objects."""
    return spark.read.schema(GOLD).json(path, multiLine=True)
