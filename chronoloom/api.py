"""The graph's tools over a store: each call is a DataFrame in, a DataFrame out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.common import table
from chronoloom.functions.columns import GRACE_SECONDS, memory_class, soft_live
from chronoloom.operators import dedup, extract, graph, learning, lifecycle, retrieval, search, vectors
from chronoloom.sources.store import GraphStore


class Graph:
    """Opens or creates a store and offers search, traversal, retrieval, learning and forgetting over it."""

    def __init__(self, spark: SparkSession, path: str, *, create: bool = False):
        self.spark = spark
        self.store = GraphStore.create(spark, path, exist_ok=True) if create else GraphStore.open(spark, path)

    # --- ingestion ---
    def add_episodes(self, episodes: DataFrame, *, at: Column | None = None, threshold: float = 0.85) -> dict[str, DataFrame]:
        """Adds a batch of episodes with the entities and relations that rules find in them.

        Entities are resolved against the store by alias and name; edges get the
        episode as provenance and end the current edges they contradict when
        these are uncertain. Returns the new entities, edges and contradictions.
        """
        at = at if at is not None else F.current_timestamp()
        s = self.store
        s.insert_or_ignore("episodes", episodes)
        named = extract.mentions(episodes, id="id", text="content")
        ids = F.sha2(F.concat_ws("|", F.lower("mention"), "type"), 256)
        new = named.select(ids.alias("id"), F.col("mention").alias("name"), "type").dropDuplicates(["id"])
        known = s.table("entities").select("id", "name", F.col("entity_type").alias("type"))
        done = dedup.resolve(new, known, s.table("aliases"), least=threshold)
        fresh = new.join(done.filter("how = 'new'").select("id"), "id", "left_semi")
        ents = fresh.select("id", "name", F.col("type").alias("entity_type"), at.alias("created_at"), F.lit("fact").alias("memory_type"), F.lit(7_776_000).alias("ttl_seconds"))
        canon = new.join(done, "id").select("name", F.col("canonical_id"), "how", "type")
        links = named.join(canon, named.mention == canon.name).select(F.col("id").alias("episode_id"), F.col("canonical_id").alias("entity_id")).distinct()
        rel = extract.relations(extract.sentences(episodes, id="id", text="content"), id="id")
        by = canon.groupBy("name").agg(F.min("canonical_id").alias("c"))
        edges = rel.join(by.select(F.col("name").alias("head"), F.col("c").alias("source_id")), "head").join(by.select(F.col("name").alias("tail"), F.col("c").alias("target_id")), "tail")
        edges = edges.select(
            F.sha2(F.concat_ws("|", "id", "source_id", "relation", "target_id"), 256).alias("id"), "source_id", "target_id", "relation",
            F.concat_ws(" ", "head", "relation", "tail").alias("fact"), at.alias("recorded_at"), F.lit(0.65).alias("confidence"), F.col("id").alias("episode_id"), F.lit("fact").alias("memory_type"), F.lit(7_776_000).alias("ttl_seconds"),
        ).dropDuplicates(["id"])
        # written before the tables that they read are replaced, so that they can be read afterwards
        ents, edges = table(ents, "entities"), table(edges, "edges")
        against = table(graph.contradictions(edges, s.table("edges")), "against")
        s.replace("edges", graph.invalidate(s.table("edges"), against.filter("silent"), at, by="new_id").unionByName(s.shaped("edges", edges)).dropDuplicates(["id"]))
        s.insert_or_ignore("aliases", canon.filter("how = 'name'").select(F.sha2(F.concat_ws("|", "canonical_id", "name"), 256).alias("alias_id"), "canonical_id", F.col("name").alias("alias_name")))
        s.insert_or_ignore("episode_entities", links)
        s.insert_or_ignore("entities", ents)
        return {"entities": ents, "edges": edges, "contradictions": against.filter("NOT silent")}

    # --- queries ---
    def search(self, text: str, *, limit: int = 10, after: str | None = None, source: str | None = None, vector: list[float] | None = None) -> DataFrame:
        """Episodes by text, fused with vector similarity where a vector is given."""
        eps = self.store.table("episodes")
        eps = eps.filter(F.col("recorded_at") >= F.lit(after).cast("timestamp")) if after else eps
        eps = eps.filter(F.col("source") == source) if source else eps
        hits = search.bm25(eps, text, ["content", "source", "metadata"], id="id")
        if vector is None:
            return search.top(hits, limit, id="id")
        near = vectors.similar(self.store.table("embeddings"), vector, embedding="embedding").select("id", "similarity").join(eps.select("id"), "id", "left_semi")
        return search.fused(hits, near, id="id", limit=limit)

    def get_decision(self, id: str) -> DataFrame:
        """An episode with the entities linked to it."""
        links = self.store.table("episode_entities").filter(F.col("episode_id") == id).select(F.col("entity_id").alias("id"))
        names = self.store.table("entities").join(F.broadcast(links.distinct()), "id", "left_semi").agg(F.array_sort(F.collect_set("name")).alias("entities"))
        return self.store.get("episodes", id).join(F.broadcast(names))  # one row

    def traverse(self, names: list[str], *, depth: int = 2) -> dict[str, DataFrame]:
        """The nodes within ``depth`` (5 at most) steps of the named entities and the current edges among them.

        Of several names the unknown ones are skipped; a single unknown name is an error.
        """
        seeds = self.store.table("entities").filter(F.col("name").isin(names)).groupBy("name").agg(F.min("id").alias("seed"))
        if len(names) == 1 and seeds.isEmpty():
            raise KeyError(f"no entity is named {names[0]}")
        nodes = graph.traverse(self.store.table("edges"), seeds.select("seed"), depth=min(depth, 5))
        return {"nodes": nodes, "edges": graph.induced(graph.current(self.store.table("edges")), nodes)}

    def entity(self, name: str, entity_type: str | None = None) -> DataFrame:
        """The entity with an exact name, of a type where one is given: the first by id."""
        df = self.store.table("entities").filter(F.col("name") == name)
        df = df.filter(F.col("entity_type") == entity_type) if entity_type else df
        return df.orderBy("id").limit(1)

    def embed(self, name: str, text: str, *, encoder: Callable[..., DataFrame] = vectors.hashed_embedding) -> None:
        """Stores the vectors of a table's rows that have none yet; ``encoder`` (frame, text column) -> frame with ``embedding``."""
        rows = self.store.table(name).select("id", F.col(text).alias("_text")).filter("_text IS NOT NULL")
        rows = rows.join(self.store.table("embeddings").select("id"), "id", "left_anti")
        self.store.insert_or_ignore("embeddings", encoder(rows, "_text").select("id", F.col("embedding").cast("array<float>").alias("embedding")))

    def patterns(self, *, limit: int = 20) -> DataFrame:
        """Stored patterns, the most frequent first."""
        return self.store.table("patterns").orderBy(F.desc("episodes"), "id").limit(limit)

    def find_precedents(self, vector: list[float], *, limit: int = 5) -> DataFrame:
        near = vectors.similar(self.store.table("embeddings"), vector, embedding="embedding").select("id", "similarity")
        return search.top(near, limit, id="id", score="similarity")

    def list_entities(self, entity_type: str | None = None, *, limit: int = 50, offset: int = 0) -> DataFrame:
        df = self.store.table("entities").filter(soft_live())
        df = df.filter(F.col("entity_type") == entity_type) if entity_type else df
        return df.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)

    def export_graph(self, path: str, *, entity_type: str | None = None, kind: str = "json") -> None:
        self.store.export(path, entity_type=entity_type, kind=kind)

    def stats(self) -> DataFrame:
        t = self.store.tables()
        return t["episodes"].agg(F.count("*").alias("episodes")).join(F.broadcast(t["entities"].filter(soft_live()).agg(F.count("*").alias("entities")))).join(F.broadcast(t["edges"].filter(soft_live()).agg(F.count("*").alias("edges"))))

    def retrieve_for_context(self, text: str, *, now: Column | None = None, budget: int = 20_000) -> DataFrame:
        return retrieval.context(self.store.tables(), text, now if now is not None else F.current_timestamp(), budget=budget)

    # --- learning and forgetting ---
    def learn(self, *, agent: str = "default", scope: str = "private", dry_run: bool = False, describe: Callable[[DataFrame], DataFrame] = learning.described) -> DataFrame:
        """Mines and stores patterns, makes skills of what edges show and supersedes the older ones that share a type.

        ``describe`` adds ``description`` to mined patterns; a stored pattern is kept as it is.
        """
        new = learning.skills(self.store.table("edges"), self.store.table("entities"))
        if dry_run:
            return new
        t = self.store.tables()
        mined = describe(learning.patterns(t["episodes"], t["episode_entities"], t["entities"], t["edges"]))
        self.store.insert_or_ignore("patterns", mined.select(F.sha2(F.concat_ws("|", "kind", "key"), 256).alias("id"), "kind", "key", F.col("types").alias("entity_types"), "episodes", "confidence", "description", F.current_timestamp().alias("created_at")))
        rows = new.select(
            F.sha2(F.concat_ws("|", "id", F.col("success_count").cast("string"), F.col("failure_count").cast("string")), 256).alias("id"),
            F.concat_ws(" / ", "a", "b").alias("name"), "description", "success_count", "failure_count", "confidence",
            F.array("a", "b").alias("entity_types"), F.lit(scope).alias("scope"), F.lit(agent).alias("created_by_agent"), F.current_timestamp().alias("created_at"),
        )
        old = self.store.table("skills")
        gone = learning.supersede(rows, old).select(F.col("old_id").alias("id"), F.col("superseded_by").alias("_s"))
        kept = old.join(gone, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "_s")).drop("_s")
        fresh = self.store.shaped("skills", rows).join(old.select("id"), "id", "left_anti")
        self.store.replace("skills", kept.unionByName(fresh))
        return self.store.table("skills").filter("superseded_by IS NULL")

    def skills_for(self, agent: str, text: str = "", *, limit: int = 10) -> DataFrame:
        """Visible skills, by text where there is one, never below 0.8."""
        seen = learning.visible(self.store.table("skills"), agent)
        if not text.strip():
            return seen.withColumn("score", F.lit(0.8)).orderBy(F.desc("confidence"), "id").limit(limit)
        hits = search.bm25(self.store.table("skills").filter("superseded_by IS NULL"), text, ["id", "name", "description"], id="id")
        return search.top(seen.join(hits, "id").withColumn("score", F.greatest("score", F.lit(0.8))), limit, id="id")

    def skills(self, *, every: bool = False) -> DataFrame:
        """Active skills, or all with those that others supersede, the surest first."""
        df = self.store.table("skills")
        return (df if every else df.filter("superseded_by IS NULL")).orderBy(F.desc("confidence"), "id")

    def share_skill(self, id: str) -> None:
        df = self.store.table("skills")
        self.store.replace("skills", df.withColumn("scope", F.when(F.col("id") == id, "shared").otherwise(F.col("scope"))))

    def forget(self, *, ids: list[str] | None = None, memory: str | None = None, hard: bool = False) -> None:
        """Softly expires rows by id or class, or removes them with what hangs on them."""
        now = F.current_timestamp()
        for name in ("entities", "edges"):
            df = self.store.table(name)
            hit = F.col("id").isin(ids) if ids is not None else memory_class() == memory
            if memory == "pattern":
                raise ValueError("patterns do not expire")
            if not hard:
                self.store.replace(name, lifecycle.mark_for_deletion(df, hit, now))
        if hard:
            t = self.store.tables()
            hit = F.col("id").isin(ids) if ids is not None else memory_class() == memory
            # written first: the tables that the ids come from are replaced one by one
            gone = table(t["entities"].filter(hit).select("id").unionByName(t["edges"].filter(hit).select("id")), "gone")
            for name, df in lifecycle.expire(gone, t).items():
                self.store.replace(name, df)

    def cleanup(self, *, now: Column | None = None, grace_seconds: int = GRACE_SECONDS) -> None:
        t = self.store.tables()
        done = lifecycle.apply_cleanup(t, now if now is not None else F.current_timestamp(), grace_seconds=grace_seconds)
        # all results are written before the first table is replaced, since each reads the entities
        for name, df in {k: table(v, k) for k, v in done.items()}.items():
            self.store.replace(name, df)
