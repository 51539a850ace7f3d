"""Registered queries of the graph engine: lists, search, vectors, filters, joins, aggregates, ranking, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.common import load
from chronoloom.functions.columns import archived, flag, memory_class, seconds, soft_live, terms, tokens_of
from chronoloom.operators import dedup, graph, learning, lifecycle, retrieval, search, vectors
from chronoloom.plans.base import CLASS, DEFAULT_TTL, LIVE, SQL, T, TTL, bm25_sql, decay_sql, flag_sql, now, once, phrase_sql, query, tables, word_sql, words_sql

ENT, EDG, EPI = "(SELECT DISTINCT * FROM entities)", "(SELECT DISTINCT * FROM edges)", "(SELECT DISTINCT * FROM episodes)"
LINKS = "(SELECT DISTINCT episode_id, entity_id FROM episode_entities)"


# --- lists and lookups ---
@query(f"""SELECT id, source, epoch_us(recorded_at) AS recorded_us FROM {EPI} WHERE source = 'slack' AND recorded_at >= TIMESTAMPTZ '2022-01-01 00:00:00+00'
ORDER BY recorded_at DESC, id LIMIT 50 OFFSET 10""")
def list_episodes(spark, sf_dir):
    """A page of episodes of one source after a time, newest first (a top-k report)."""
    df = once(spark, sf_dir, "episodes", "id", "source", "recorded_at").filter((F.col("source") == "slack") & (F.col("recorded_at") >= F.lit("2022-01-01").cast("timestamp")))
    return df.orderBy(F.desc("recorded_at"), "id").offset(10).limit(50).select("id", "source", seconds("recorded_at").alias("recorded_us"))


@query(f"SELECT id, name, epoch_us(created_at) AS created_us FROM {ENT} WHERE entity_type = 'Component' AND {LIVE} ORDER BY created_at DESC, id LIMIT 100")
def list_entities(spark, sf_dir):
    """The newest live entities of a type (a top-k report)."""
    df = once(spark, sf_dir, "entities", "id", "name", "entity_type", "created_at", "metadata").filter((F.col("entity_type") == "Component") & soft_live())
    return df.orderBy(F.desc("created_at"), "id").limit(100).select("id", "name", seconds("created_at").alias("created_us"))


@query("SELECT name, min(id) AS id FROM entities WHERE name IS NOT NULL GROUP BY name")
def entity_by_name(spark, sf_dir):
    """The entity that an exact name means: the first by id."""
    return load(spark, sf_dir, "entities").filter("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"))


@query("SELECT DISTINCT id, name FROM entities WHERE entity_type = 'Database'")
def entity_names_by_type(spark, sf_dir):
    return load(spark, sf_dir, "entities").filter("entity_type = 'Database'").select("id", "name").distinct()


@query("SELECT lower(alias_name) AS alias, count(DISTINCT canonical_id) AS n, min(canonical_id) AS first_id FROM aliases WHERE canonical_id IS NOT NULL AND alias_name IS NOT NULL GROUP BY 1")
def alias_lookup(spark, sf_dir):
    """Entities by alias in any letter case."""
    a = load(spark, sf_dir, "aliases").filter("canonical_id IS NOT NULL AND alias_name IS NOT NULL")
    return a.groupBy(F.lower("alias_name").alias("alias")).agg(F.countDistinct("canonical_id").alias("n"), F.min("canonical_id").alias("first_id"))


@query("""SELECT DISTINCT canonical_id, alias_name FROM aliases a WHERE canonical_id IS NOT NULL AND alias_name IS NOT NULL AND NOT EXISTS (
SELECT 1 FROM aliases o WHERE o.similarity >= 0.95 AND o.canonical_id = a.canonical_id AND o.alias_name = a.alias_name)""")
def add_aliases(spark, sf_dir):
    """Insert or ignore on (canonical_id, alias_name): what is new against the aliases of similarity 0.95 and more."""
    a = load(spark, sf_dir, "aliases").select("canonical_id", "alias_name", "similarity")
    old = a.filter("similarity >= 0.95").select("canonical_id", "alias_name")
    return a.select("canonical_id", "alias_name").dropna().distinct().join(old, ["canonical_id", "alias_name"], "left_anti")


@query("SELECT episode_id, entity_id, min(span_start) AS span_start FROM episode_entities GROUP BY ALL")
def link_episodes(spark, sf_dir):
    """Links of episodes and entities, each pair once with its first span."""
    return load(spark, sf_dir, "episode_entities").groupBy("episode_id", "entity_id").agg(F.min("span_start").alias("span_start"))


@query(f"""SELECT e.id, e.source_id, e.target_id, e.relation FROM {EDG} e WHERE {LIVE.replace('metadata', 'e.metadata')} AND (
e.source_id IN (SELECT id FROM entities WHERE entity_type = 'Database' AND {LIVE}) OR e.target_id IN (SELECT id FROM entities WHERE entity_type = 'Database' AND {LIVE}))""")
def export_graph(spark, sf_dir):
    """The edges that touch the live entities of a type, each once."""
    ent = load(spark, sf_dir, "entities").filter((F.col("entity_type") == "Database") & soft_live())
    return graph.touching(once(spark, sf_dir, "edges", "id", "source_id", "target_id", "relation", "metadata").filter(soft_live()), ent).select("id", "source_id", "target_id", "relation")


# --- full-text search ---
def _best(spark, sf_dir, table, text, columns, keep=None, k=20):
    """The best rows of a table that has repeated ones: only ids and counts are compared for that."""
    df = load(spark, sf_dir, table)
    hits = search.bm25(df.filter(keep) if keep is not None else df, text, columns, id="id", repeats=True)
    return search.top(hits, k, id="id").withColumn("score", F.round("score", 6))


COLS = ["content", "source", "metadata"]


@query(bm25_sql(EPI, COLS, [word_sql("retention"), word_sql("rule")], "f0 > 0 AND f1 > 0"))
def search_episodes(spark, sf_dir):
    return _best(spark, sf_dir, "episodes", "retention RULE", COLS)


@query(bm25_sql(f"(SELECT * FROM {ENT} WHERE {LIVE})", ["name", "entity_type", "summary"], [word_sql("cache"), word_sql("component")], "f0 > 0 AND f1 > 0"))
def search_entities(spark, sf_dir):
    return _best(spark, sf_dir, "entities", "cache component", ["name", "entity_type", "summary"], soft_live())


@query(bm25_sql(f"(SELECT * FROM {EDG} WHERE {LIVE})", ["fact", "relation"], [word_sql("replaced"), word_sql("mossdb")], "f0 > 0 AND f1 > 0"))
def search_edges(spark, sf_dir):
    return _best(spark, sf_dir, "edges", "replaced Mossdb?", ["fact", "relation"], soft_live())


@query(bm25_sql(EPI, COLS, [phrase_sql("no", "data", "was", "lost")], "f0 > 0"))
def search_phrase(spark, sf_dir):
    """A phrase is one term with its own frequency."""
    return _best(spark, sf_dir, "episodes", '"no data was lost"', COLS)


@query(bm25_sql(EPI, COLS, [word_sql("backfill"), word_sql("timeline")], "(f0 > 0 OR f1 > 0) AND x0 = 0", extra=", " + word_sql("slack") + " AS x0"))
def search_boolean(spark, sf_dir):
    """OR sums the sides that match, NOT only excludes."""
    return _best(spark, sf_dir, "episodes", "backfill OR timeline NOT slack", COLS)


@query(bm25_sql(EPI, COLS, ["len(list_filter(w, lambda x: starts_with(x, 'deprec')))"], "f0 > 0"))
def search_prefix(spark, sf_dir):
    return _best(spark, sf_dir, "episodes", "deprec*", COLS)


@query(rf"""WITH d AS (SELECT id, list_filter(regexp_split_to_array(lower(strip_accents(concat_ws(' ', content, source, metadata))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w,
 list_filter(regexp_split_to_array(lower(strip_accents(coalesce(source, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS v FROM {EPI}),
f AS (SELECT id, len(w) AS l, len(list_filter(v, lambda x: x = 'email')) AS f0 FROM d), s AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (f0 > 0) AS n0 FROM f)
SELECT id, round(ln((n - n0 + 0.5) / (n0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / a)), 6) AS score FROM f, s WHERE f0 > 0
ORDER BY ln((n - n0 + 0.5) / (n0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / a)) DESC, id LIMIT 20""")
def search_column(spark, sf_dir):
    return _best(spark, sf_dir, "episodes", "source:email", COLS)


# --- vectors and fusion ---
COS = "CASE WHEN len({0}) = len({1}) AND list_dot_product({0}::DOUBLE[], {0}::DOUBLE[]) > 0 AND list_dot_product({1}::DOUBLE[], {1}::DOUBLE[]) > 0 THEN list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]) ELSE 0 END"


@query(f"""WITH s AS (SELECT b.vec_id, {COS.format('a.embedding', 'b.embedding')} AS c FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0)
SELECT vec_id, round(c, 6) AS similarity FROM s ORDER BY c DESC, vec_id LIMIT 25""")
def precedents(spark, sf_dir):
    """The rows most like one row's vector (a top-k report)."""
    e = load(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()
    got = vectors.similar(e.filter("vec_id <> 0"), q.embedding, embedding="embedding").select("vec_id", "similarity")
    return search.top(got, 25, id="vec_id", score="similarity").withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {COS.format('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(c, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10""")
def nearest_vectors(spark, sf_dir):
    """The ten nearest of every hundredth row, against all rows."""
    e = load(spark, sf_dir, "embeddings")
    got = vectors.nearest(e, e.filter("vec_id % 100 = 0"), id="vec_id", embedding="embedding", k=10)
    return got.withColumn("similarity", F.round("similarity", 6))


def _fused(spark, sf_dir, only=None, limit=30):
    docs, e = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source"), load(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 7").select("embedding").first()
    near = vectors.similar(e, q.embedding, embedding="embedding").select(F.col("vec_id").alias("id"), "similarity")
    keep = docs.filter(F.col("source") == only) if only else None  # ranks keep the gaps of the rows left out
    got = search.fused(search.bm25(docs, "benchmark replication", ["text", "source"], id="id"), near, id="id", limit=limit, keep=keep)
    return got.withColumn("score", F.round("score", 8))


def _fused_sql(only: str = "", limit: int = 30) -> str:
    leg = bm25_sql("(SELECT doc_id AS id, text, source FROM documents)", ["text", "source"], [word_sql("benchmark"), word_sql("replication")], "f0 > 0 AND f1 > 0", max(10 * limit, 200))
    keep = f"WHERE id IN (SELECT doc_id FROM documents WHERE source = '{only}')" if only else ""
    return f"""WITH t AS ({leg}), t2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM t),
v AS (SELECT b.vec_id AS id, {COS.format('a.embedding', 'b.embedding')} AS c FROM embeddings a, embeddings b WHERE a.vec_id = 7),
v2 AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS r FROM v), u AS (SELECT id, r FROM t2 UNION ALL SELECT id, r FROM v2)
SELECT id, round(sum(1.0 / (60 + r)), 8) AS score FROM u {keep} GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT {limit}"""


@query(_fused_sql())
def search_fused(spark, sf_dir):
    """Text and vector ranks fused; every vector is ranked."""
    return _fused(spark, sf_dir)


@query(_fused_sql("wiki_page"))
def search_fused_source(spark, sf_dir):
    return _fused(spark, sf_dir, "wiki_page")


# --- filters ---
@query(f"SELECT {flag_sql('marked_for_deletion')} AS marked, {flag_sql('archived')} AS archived, count(*) AS n FROM {ENT} GROUP BY ALL")
def entity_flags(spark, sf_dir):
    """Visible, archived and softly expired entities; unreadable metadata means visible."""
    return once(spark, sf_dir, "entities", "id", "metadata").groupBy(flag("metadata", "marked_for_deletion").alias("marked"), archived().alias("archived")).agg(F.count("*").alias("n"))


AT = "TIMESTAMPTZ '2023-06-01 00:00:00+00'"


@query(f"SELECT id, source_id, relation, target_id FROM {EDG} WHERE (valid_from IS NULL OR valid_from <= {AT}) AND (valid_until IS NULL OR valid_until > {AT}) AND recorded_at <= {AT}")
def edges_as_of(spark, sf_dir):
    """The graph as valid at a time and on record by then."""
    t = F.lit("2023-06-01").cast("timestamp")
    return graph.as_of(once(spark, sf_dir, "edges", "id", "source_id", "target_id", "relation", "valid_from", "valid_until", "recorded_at"), t, known=t).select("id", "source_id", "relation", "target_id")


@query(f"SELECT relation, count(*) AS n, count(valid_until) AS ended FROM {EDG} WHERE recorded_at BETWEEN TIMESTAMPTZ '2022-01-01 00:00:00+00' AND TIMESTAMPTZ '2022-12-31 00:00:00+00' GROUP BY relation")
def edges_audit(spark, sf_dir):
    """What was recorded in a range of time."""
    e = once(spark, sf_dir, "edges", "id", "relation", "valid_until", "recorded_at").filter(F.col("recorded_at").between(F.lit("2022-01-01").cast("timestamp"), F.lit("2022-12-31").cast("timestamp")))
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.count("valid_until").alias("ended"))


# --- joins ---
HUB = "(SELECT target_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT id, relation, epoch_us(recorded_at) AS recorded_us FROM {EDG} WHERE (source_id = {HUB} OR target_id = {HUB}) AND valid_until IS NULL AND {LIVE}")
def edges_of_hub(spark, sf_dir):
    """Current edges at either end of the most linked entity."""
    e = once(spark, sf_dir, "edges", "id", "source_id", "target_id", "relation", "recorded_at", "valid_until", "metadata")
    hub = load(spark, sf_dir, "edges").groupBy("target_id").count().orderBy(F.desc("count"), "target_id").first().target_id
    return graph.edges_of(e, hub, only_current=True).select("id", "relation", seconds("recorded_at").alias("recorded_us"))


@query(f"""WITH n AS (SELECT id FROM entities WHERE entity_type IN ('Database', 'Service'))
SELECT relation, count(*) AS n FROM {EDG} WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) GROUP BY relation""")
def induced_subgraph(spark, sf_dir):
    n = load(spark, sf_dir, "entities").filter(F.col("entity_type").isin("Database", "Service")).select("id")
    return graph.induced(once(spark, sf_dir, "edges", "id", "source_id", "target_id", "relation"), n).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT l.entity_id AS id, e.name FROM {LINKS} l JOIN {EPI} p ON p.id = l.episode_id JOIN {ENT} e ON e.id = l.entity_id WHERE p.source IS DISTINCT FROM 'compression'""")
def linked_entities(spark, sf_dir):
    """Entities of episodes that aren't compressions."""
    eps = learning.plain_episodes(load(spark, sf_dir, "episodes")).select(F.col("id").alias("episode_id"))
    l = load(spark, sf_dir, "episode_entities").join(eps, "episode_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
    return l.join(once(spark, sf_dir, "entities", "id", "name"), "id")


@query(f"""WITH e AS (SELECT * FROM {EDG} WHERE valid_until IS NULL AND {LIVE}), b AS (SELECT source_id AS a, target_id AS b FROM e UNION ALL SELECT target_id, source_id FROM e WHERE source_id <> target_id)
SELECT a AS id, count(*) AS edges, count(DISTINCT b) AS neighbours FROM b WHERE a IN (SELECT id FROM entities) GROUP BY a""")
def entity_context(spark, sf_dir):
    """Current edges and distinct neighbours of every entity."""
    n = graph.neighbours(once(spark, sf_dir, "edges", "id", "source_id", "target_id", "valid_until", "metadata"), load(spark, sf_dir, "entities"), distinct=False)
    return n.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("edges"), F.countDistinct("neighbour").alias("neighbours"))


NEWER = "TIMESTAMPTZ '2025-10-01 00:00:00+00'"


@query(f"""WITH n AS (SELECT * FROM {EDG} WHERE recorded_at >= {NEWER})
SELECT DISTINCT n.id AS new_id, e.id AS existing_id, coalesce(e.confidence, 1.0) < 0.6 AS silent FROM n JOIN {EDG} e ON e.source_id = n.source_id AND e.relation = n.relation AND e.target_id <> n.target_id
WHERE e.recorded_at < {NEWER} AND e.valid_until IS NULL AND {LIVE.replace('metadata', 'e.metadata')}""")
def contradictions(spark, sf_dir):
    """Current edges that contradict the edges of the newest batch."""
    e = once(spark, sf_dir, "edges", "id", "source_id", "target_id", "relation", "confidence", "valid_until", "metadata", "recorded_at")
    new = e.filter(F.col("recorded_at") >= F.lit("2025-10-01").cast("timestamp"))
    return graph.contradictions(new, e, threshold=0.6)


@query(f"""WITH n AS (SELECT * FROM {EDG} WHERE recorded_at >= {NEWER}), c AS (
SELECT e.id AS existing_id, min(n.id) AS by FROM n JOIN {EDG} e ON e.source_id = n.source_id AND e.relation = n.relation AND e.target_id <> n.target_id
WHERE e.recorded_at < {NEWER} AND e.valid_until IS NULL AND {LIVE.replace('metadata', 'e.metadata')} GROUP BY e.id)
SELECT e.relation, count(*) AS n, count(c.by) AS ended, count(*) FILTER (WHERE e.valid_until IS NULL AND c.by IS NULL) AS still_open, min(c.by) AS least_by FROM {EDG} e LEFT JOIN c ON c.existing_id = e.id GROUP BY e.relation""")
def invalidate_contradicted(spark, sf_dir):
    """The edges after contradicted ones are ended, counted by relation."""
    e = once(spark, sf_dir, "edges", "id", "source_id", "target_id", "relation", "confidence", "valid_until", "metadata", "recorded_at")
    new = e.filter(F.col("recorded_at") >= F.lit("2025-10-01").cast("timestamp"))
    out = graph.invalidate(e, graph.contradictions(new, e), now(), by="new_id")
    by = F.get_json_object("metadata", "$.contradicted_by")
    return out.groupBy("relation").agg(F.count("*").alias("n"), F.count(by).alias("ended"), F.count_if(F.col("valid_until").isNull()).alias("still_open"), F.min(by).alias("least_by"))


@query(f"""WITH n AS (SELECT id, name, entity_type AS type FROM {ENT} WHERE created_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' AND name IS NOT NULL AND entity_type IS NOT NULL),
k AS (SELECT id, name, entity_type AS type FROM {ENT} WHERE created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00'),
a AS (SELECT trim(lower(alias_name)) AS an, min(canonical_id) AS by_alias FROM aliases WHERE canonical_id IS NOT NULL AND alias_name IS NOT NULL GROUP BY 1),
m AS (SELECT n.id, trim(lower(n.name)) AS name, n.type, a.by_alias FROM n LEFT JOIN a ON a.an = trim(lower(n.name))),
s AS (SELECT m.id, k.id AS kid, row_number() OVER (PARTITION BY m.id ORDER BY jaro_winkler_similarity(m.name, trim(lower(k.name))) DESC, k.id) AS r
  FROM m JOIN k ON k.type = m.type WHERE m.by_alias IS NULL AND jaro_winkler_similarity(m.name, trim(lower(k.name))) >= 0.85)
SELECT m.id, coalesce(m.by_alias, s.kid, m.id) AS canonical_id, CASE WHEN m.by_alias IS NOT NULL THEN 'alias' WHEN s.kid IS NOT NULL THEN 'name' ELSE 'new' END AS how
FROM m LEFT JOIN s ON s.id = m.id AND s.r = 1""")
def dedup_entities(spark, sf_dir):
    """The newest entities against the older ones: by alias, else by Jaro-Winkler within the type."""
    e = once(spark, sf_dir, "entities", "id", "name", "entity_type", "created_at").select("id", "name", F.col("entity_type").alias("type"), "created_at")
    cut = F.lit("2025-07-01").cast("timestamp")
    new = e.filter((F.col("created_at") >= cut) & F.col("name").isNotNull() & F.col("type").isNotNull())
    return dedup.resolve(new, e.filter(F.col("created_at") < cut), load(spark, sf_dir, "aliases"))


# --- aggregates ---
@query(f"""SELECT (SELECT count(*) FROM {EPI}) AS episodes, (SELECT count(*) FROM {ENT} WHERE {LIVE}) AS entities, (SELECT count(*) FROM {EDG} WHERE {LIVE}) AS edges,
(SELECT count(*) FROM {ENT} WHERE ttl_seconds > 0 AND {CLASS} <> 'pattern' AND epoch_us({T}) - epoch_us(created_at) > (604800 + ttl_seconds) * 1000000) AS decayed_entities""")
def stats(spark, sf_dir):
    """Counts of the graph's tables; softly expired rows don't count, archived ones do."""
    eps = once(spark, sf_dir, "episodes", "id").agg(F.count("*").alias("episodes"))
    ent = once(spark, sf_dir, "entities", "id", "metadata", "ttl_seconds", "memory_type", "created_at")
    old = (F.col("ttl_seconds") > 0) & (memory_class() != "pattern") & (seconds(now()) - seconds("created_at") > (F.col("ttl_seconds") + 604_800) * 1_000_000)
    e = ent.agg(F.count_if(soft_live()).alias("entities"), F.count_if(old).alias("decayed_entities"))
    d = once(spark, sf_dir, "edges", "id", "metadata").agg(F.count_if(soft_live()).alias("edges"))
    return eps.join(F.broadcast(e)).join(F.broadcast(d)).select("episodes", "entities", "edges", "decayed_entities")  # one row each


@query(f"SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM {EPI} GROUP BY 1")
def episodes_by_source(spark, sf_dir):
    return once(spark, sf_dir, "episodes", "id", "source").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


@query(f"SELECT {CLASS} AS memory, count(*) AS n FROM {ENT} WHERE {LIVE} AND NOT {flag_sql('archived')} GROUP BY 1")
def entities_by_class(spark, sf_dir):
    return once(spark, sf_dir, "entities", "id", "metadata", "memory_type", "ttl_seconds", "created_at").filter(soft_live() & ~archived()).groupBy(memory_class().alias("memory")).agg(F.count("*").alias("n"))


@query(f"""SELECT {CLASS} AS memory, count(*) AS n FROM {ENT} WHERE {LIVE} AND NOT {flag_sql('archived')} AND ttl_seconds > 0 AND {CLASS} <> 'pattern'
AND epoch_us({T}) - epoch_us(created_at) > (604800 + ttl_seconds) * 1000000 GROUP BY 1""")
def decayed_by_class(spark, sf_dir):
    old = (F.col("ttl_seconds") > 0) & (memory_class() != "pattern") & (seconds(now()) - seconds("created_at") > (F.col("ttl_seconds") + 604_800) * 1_000_000)
    return once(spark, sf_dir, "entities", "id", "metadata", "memory_type", "ttl_seconds", "created_at").filter(soft_live() & ~archived() & old).groupBy(memory_class().alias("memory")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT DISTINCT id AS episode_id FROM episodes WHERE source IS DISTINCT FROM 'compression'), t AS (SELECT count(*) AS total FROM p),
n AS (SELECT DISTINCT id AS entity_id, name, entity_type AS type FROM entities),
per AS (SELECT DISTINCT l.episode_id, n.name, n.type FROM {LINKS} l JOIN p USING (episode_id) JOIN n USING (entity_id)),
ty AS (SELECT 'type' AS kind, type AS key, [type] AS types, count(DISTINCT episode_id) AS n FROM per WHERE type IS NOT NULL GROUP BY type),
pa AS (SELECT 'pair' AS kind, a.name || '|' || b.name AS key, list_sort(list_distinct(list(a.type) || list(b.type))) AS types, count(DISTINCT episode_id) AS n FROM per a JOIN per b USING (episode_id) WHERE a.name < b.name GROUP BY a.name, b.name),
tr AS (SELECT 'triplet' AS kind, s.name || '|' || e.relation || '|' || d.name AS key, list_sort(list_distinct(list(s.type) || list(d.type))) AS types, count(DISTINCT e.episode_id) AS n
  FROM {EDG} e JOIN p USING (episode_id) JOIN n s ON s.entity_id = e.source_id JOIN n d ON d.entity_id = e.target_id WHERE e.valid_until IS NULL GROUP BY s.name, e.relation, d.name),
u AS (SELECT * FROM ty UNION ALL SELECT * FROM pa UNION ALL SELECT * FROM tr)
SELECT kind, key, array_to_string(types, ',') AS types, n AS episodes, round(n / total, 8) AS confidence FROM u, t WHERE n >= 2 AND len(types) >= 1 ORDER BY n DESC, kind, key LIMIT 50""")
def mined_patterns(spark, sf_dir):
    """Types, pairs of names and triplets that recur in at least two episodes (a top-k report)."""
    t = tables(spark, sf_dir, episodes=("id", "source"), entities=("id", "name", "entity_type"), edges=("id", "source_id", "target_id", "relation", "valid_until", "episode_id"))
    got = learning.patterns(t["episodes"], t["episode_entities"], t["entities"], t["edges"], least=2, least_types=1, most=50)
    return got.withColumns({"types": F.array_join("types", ","), "confidence": F.round("confidence", 8)})


SKILLS_SQL = f"""WITH t AS (SELECT DISTINCT id, entity_type AS type FROM entities WHERE entity_type IS NOT NULL), e AS (SELECT DISTINCT id, source_id, target_id, relation FROM edges),
p AS (SELECT least(s.type, d.type) AS a, greatest(s.type, d.type) AS b, relation, count(*) AS n FROM e JOIN t s ON s.id = e.source_id JOIN t d ON d.id = e.target_id GROUP BY 1, 2, 3),
g AS (SELECT a, b, coalesce(sum(n) FILTER (relation IN ('fixed', 'resolved', 'success')), 0)::BIGINT AS success_count, coalesce(sum(n) FILTER (relation IN ('deprecated', 'failed', 'abandoned')), 0)::BIGINT AS failure_count,
  first(relation ORDER BY n DESC, relation DESC) AS relation FROM p GROUP BY a, b)
SELECT a, b, relation, success_count, failure_count, round(success_count / (success_count + failure_count), 8) AS confidence,
  a || ' and ' || b || ': mostly ' || relation || ', ' || success_count || ' fixed, ' || failure_count || ' failed' AS description FROM g WHERE success_count + failure_count > 0"""


@query(SKILLS_SQL)
def skills(spark, sf_dir):
    """A skill for each pair of entity types from the outcomes of their edges."""
    got = learning.skills(load(spark, sf_dir, "edges"), load(spark, sf_dir, "entities"))
    return got.drop("id").withColumn("confidence", F.round("confidence", 8))


# --- decay, staleness, lifecycle ---
ENT_DECAY = decay_sql(CLASS, "created_at", TTL, "coalesce(usage_count, 0)", "last_recalled_at")


@query(f"SELECT id, round({ENT_DECAY}, 6) AS strength FROM {ENT}")
def decay_scores(spark, sf_dir):
    """What is left of every entity's strength."""
    return once(spark, sf_dir, "entities", "id", "memory_type", "created_at", "ttl_seconds", "usage_count", "last_recalled_at").select("id", F.round(lifecycle.strength(now(), created="created_at"), 6).alias("strength"))


@query(f"""WITH s AS (SELECT id, {ENT_DECAY} AS v FROM {ENT} WHERE ttl_seconds > 0)
SELECT id, round(v, 6) AS strength, CASE WHEN v > 0.7 THEN 'keep' WHEN v > 0.3 THEN 'update' ELSE 'expire' END AS action FROM s WHERE v < 0.5""")
def stale_entities(spark, sf_dir):
    got = lifecycle.stale(once(spark, sf_dir, "entities", "id", "memory_type", "created_at", "ttl_seconds", "usage_count", "last_recalled_at"), now(), created="created_at", threshold=0.5)
    return got.select("id", F.round("strength", 6).alias("strength"), "action")


@query(f"""WITH l AS (SELECT entity_id, count(*) AS n, max(recalled_at) AS m FROM (SELECT DISTINCT * FROM recall_log) WHERE entity_id IS NOT NULL GROUP BY 1)
SELECT e.id, (coalesce(e.usage_count, 0) + coalesce(l.n, 0))::BIGINT AS usage_count, epoch_us(greatest(e.last_recalled_at, l.m)) AS recalled_us FROM {ENT} e LEFT JOIN l ON l.entity_id = e.id""")
def touch_entities(spark, sf_dir):
    """Recalls of the log added to the entities' use."""
    got = lifecycle.touch(once(spark, sf_dir, "entities", "id", "usage_count", "last_recalled_at"), once(spark, sf_dir, "recall_log", "recall_id", "entity_id", "recalled_at"))
    return got.select("id", "usage_count", seconds("last_recalled_at").alias("recalled_us"))


def _action_sql(created: str) -> str:
    old = f"epoch_us({T}) - epoch_us({created}) > ({DEFAULT_TTL.format('cls')} + 604800)::BIGINT * 1000000"
    return f"CASE WHEN NOT ({LIVE}) THEN 'delete' WHEN {old} AND cls IN ('fact', 'experience') THEN 'delete' WHEN {old} AND cls IN ('preference', 'decision') THEN 'archive' ELSE 'keep' END"


AGED = ("id", "memory_type", "created_at", "metadata")
CLEAN_SQL = f"""WITH n AS (SELECT *, {CLASS} AS cls FROM {ENT}), na AS (SELECT id, {_action_sql('created_at')} AS action FROM n), gone AS (SELECT id FROM na WHERE action = 'delete'),
d AS (SELECT *, {CLASS} AS cls FROM {EDG}), da AS (SELECT id, CASE WHEN source_id IN (SELECT id FROM gone) OR target_id IN (SELECT id FROM gone) THEN 'delete' ELSE {_action_sql('recorded_at')} END AS action FROM d)"""


@query(CLEAN_SQL + " SELECT 'entities' AS tab, action, count(*) AS n FROM na GROUP BY action UNION ALL SELECT 'edges', action, count(*) FROM da GROUP BY action")
def cleanup_actions(spark, sf_dir):
    """What a cleanup deletes, archives and keeps."""
    done = lifecycle.cleanup(tables(spark, sf_dir, entities=AGED, edges=("id", "source_id", "target_id", "memory_type", "recorded_at", "metadata")), now())
    one = lambda k: done[k].groupBy(F.lit(k).alias("tab"), "action").agg(F.count("*").alias("n"))
    return one("entities").unionByName(one("edges"))


@query(CLEAN_SQL + f""", k AS (SELECT id FROM na WHERE action <> 'delete')
SELECT 'aliases' AS tab, count(*) AS n FROM aliases WHERE canonical_id IS NULL OR canonical_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'episode_entities', count(*) FROM (SELECT DISTINCT episode_id, entity_id FROM episode_entities) WHERE entity_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'entities', count(*) FROM k UNION ALL SELECT 'edges', count(*) FROM da WHERE action <> 'delete'""")
def cleanup_result(spark, sf_dir):
    """Rows of each table after a cleanup."""
    out = lifecycle.apply_cleanup(tables(spark, sf_dir, entities=AGED, edges=("id", "source_id", "target_id", "memory_type", "recorded_at", "metadata"), aliases=("alias_id", "canonical_id")), now())
    parts = [df.agg(F.lit(k).alias("tab"), F.count("*").alias("n")) for k, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"SELECT {CLASS} AS memory, count(*) AS n, count(*) FILTER ({flag_sql('marked_for_deletion')} OR {CLASS} = 'preference') AS marked FROM {ENT} GROUP BY 1")
def mark_preferences(spark, sf_dir):
    """All preferences softly expired; what is marked then, by class."""
    got = lifecycle.expire_class(once(spark, sf_dir, "entities", "id", "metadata", "memory_type"), "preference", now())
    return got.groupBy(memory_class().alias("memory")).agg(F.count("*").alias("n"), F.count_if(~soft_live()).alias("marked"))


@query(f"""WITH s AS (SELECT *, {ENT_DECAY} AS v, {CLASS} AS cls FROM {ENT})
SELECT id, CASE WHEN ttl_seconds > 0 AND v < 0.5 AND v > 0.3 THEN {DEFAULT_TTL.format('cls')} ELSE ttl_seconds END::BIGINT AS ttl_seconds,
CASE WHEN ttl_seconds > 0 AND v < 0.5 AND v > 0.3 THEN epoch_us({T}) ELSE epoch_us(created_at) END AS created_us FROM s""")
def renew_stale(spark, sf_dir):
    """Stale entities that are worth an update live on from now."""
    e = once(spark, sf_dir, "entities", "id", "ttl_seconds", "created_at", "memory_type", "usage_count", "last_recalled_at")
    ids = lifecycle.stale(e, now(), created="created_at").filter("action = 'update'").select("id")
    return lifecycle.renew(e, ids, now(), created="created_at").select("id", "ttl_seconds", seconds("created_at").alias("created_us"))


@query(f"""WITH c AS (SELECT canonical_id AS id, min(alias_name) AS content FROM aliases WHERE canonical_id IS NOT NULL AND alias_name IS NOT NULL GROUP BY 1)
SELECT e.id, coalesce(c.content, e.summary) AS summary, CASE WHEN c.id IS NOT NULL THEN 'decision' ELSE e.memory_type END AS memory_type, CASE WHEN c.id IS NOT NULL THEN 7776000 ELSE e.ttl_seconds END::BIGINT AS ttl_seconds
FROM {ENT} e LEFT JOIN c ON c.id = e.id""")
def update_memories(spark, sf_dir):
    """New content and class for many entities at once."""
    a = load(spark, sf_dir, "aliases").filter("canonical_id IS NOT NULL AND alias_name IS NOT NULL")
    c = a.groupBy(F.col("canonical_id").alias("id")).agg(F.min("alias_name").alias("content")).withColumn("memory_type", F.lit("decision"))
    return lifecycle.update(once(spark, sf_dir, "entities", "id", "summary", "memory_type", "ttl_seconds"), c, content="summary").select("id", "summary", "memory_type", "ttl_seconds")


@query(f"""WITH g AS (SELECT DISTINCT id FROM entities WHERE entity_type = 'Metric')
SELECT 'entities' AS tab, count(*) AS n FROM {ENT} WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'edges', count(*) FROM {EDG} WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'aliases', count(*) FROM aliases WHERE canonical_id IS NULL OR canonical_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'episode_entities', count(*) FROM {LINKS} WHERE entity_id NOT IN (SELECT id FROM g)""")
def expire_type(spark, sf_dir):
    """All entities of a type removed, with what hangs on them."""
    t = tables(spark, sf_dir, entities=("id", "entity_type"), edges=("id", "source_id", "target_id"), aliases=("alias_id", "canonical_id"))
    out = lifecycle.expire(t["entities"].filter("entity_type = 'Metric'").select("id"), t)
    parts = [df.agg(F.lit(k).alias("tab"), F.count("*").alias("n")) for k, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- traversal ---
def _reach_sql(depth: int, start: str) -> str:
    steps = ["SELECT s AS seed, s AS id, 0 AS depth FROM st"]
    ctes = [f"st AS ({start})", f"b AS (SELECT source_id AS a, target_id AS b FROM edges WHERE valid_until IS NULL UNION SELECT target_id, source_id FROM edges WHERE valid_until IS NULL)", "r0 AS (" + steps[0] + ")"]
    for d in range(1, depth + 1):
        ctes.append(f"r{d} AS (SELECT * FROM r{d - 1} UNION SELECT r.seed, b.b, {d} FROM r{d - 1} r JOIN b ON b.a = r.id WHERE r.depth = {d - 1})")
    return "WITH " + ", ".join(ctes) + f" SELECT seed, id, min(depth) AS depth FROM r{depth} GROUP BY seed, id"


@query(_reach_sql(2, "SELECT min(id) AS s FROM entities WHERE entity_type = 'Database'"))
def traverse(spark, sf_dir):
    """Everything within two steps of one entity over current edges."""
    start = load(spark, sf_dir, "entities").filter("entity_type = 'Database'").agg(F.min("id").alias("seed"))
    return graph.traverse(load(spark, sf_dir, "edges"), start, depth=2)


@query(_reach_sql(1, "SELECT DISTINCT id AS s FROM entities WHERE entity_type = 'Language'"))
def traverse_batch(spark, sf_dir):
    """Many seeds at once."""
    start = load(spark, sf_dir, "entities").filter("entity_type = 'Language'").select(F.col("id").alias("seed"))
    return graph.traverse(load(spark, sf_dir, "edges"), start, depth=1)


# --- retrieval ---
QUERY = "replaced mossdb"


def _memories(spark, sf_dir):
    """The tables as they are: the operators take repeated rows once after the cut, so no content is shuffled."""
    return {n: load(spark, sf_dir, n) for n in ("episodes", "entities", "edges")}


def _leg(df: str, cols: list[str]) -> str:
    return bm25_sql(df, cols, [word_sql(w) for w in QUERY.split()], "f0 > 0 AND f1 > 0", 100)


CAND_SQL = f"""WITH se AS ({_leg(f"(SELECT * FROM {ENT} WHERE {LIVE})", ["name", "entity_type", "summary"])}), sd AS ({_leg(f"(SELECT * FROM {EDG} WHERE {LIVE})", ["fact", "relation"])}), sp AS ({_leg(EPI, COLS)}),
live AS (SELECT * FROM {EDG} WHERE {LIVE} AND valid_until IS NULL), near AS (SELECT target_id AS id FROM live WHERE source_id IN (SELECT id FROM se) UNION SELECT source_id FROM live WHERE target_id IN (SELECT id FROM se)),
c AS (SELECT 'entity' AS kind, e.id, coalesce(summary, name) AS content, {CLASS} AS memory, created_at AS created, {TTL} AS ttl, 1.0::DOUBLE AS confidence, coalesce(usage_count, 0) AS usage, last_recalled_at AS recalled, score FROM {ENT} e JOIN se USING (id)
UNION ALL SELECT 'entity', e.id, coalesce(summary, name), {CLASS}, created_at, {TTL}, 1.0, coalesce(usage_count, 0), last_recalled_at, 0.3 FROM {ENT} e JOIN near USING (id) WHERE {LIVE} AND id NOT IN (SELECT id FROM se WHERE score >= 0.3)
UNION ALL SELECT 'edge', e.id, coalesce(fact, relation), {CLASS}, recorded_at, {TTL}, confidence, coalesce(usage_count, 0), last_recalled_at, score FROM {EDG} e JOIN sd USING (id)
UNION ALL SELECT 'episode', e.id, content, {CLASS}, recorded_at, {DEFAULT_TTL.format('(' + CLASS + ')')}, 1.0, 0, NULL, score FROM {EPI} e JOIN sp USING (id)),
t AS (SELECT * FROM c ORDER BY score DESC, kind, id LIMIT 100),
z AS (SELECT *, {decay_sql('memory', 'created', 'ttl', 'usage', 'recalled')} AS dec FROM t),
y AS (SELECT *, dec * (0.5 + 0.5 * least(greatest(coalesce(confidence, 1.0), 0), 1)) * least(greatest(score, 0), 1) * (1 + 0.1 * ln(1 + usage::DOUBLE)) AS raw FROM z),
x AS (SELECT *, CASE WHEN dec = 0 THEN 0 WHEN memory = 'pattern' AND raw > 0 THEN greatest(raw, 0.5) ELSE raw END AS final FROM y)"""


@query(CAND_SQL + " SELECT kind, id, round(score, 6) AS text_score FROM t")
def retrieve_candidates(spark, sf_dir):
    """Three text searches and one hop, the best score of each key."""
    got = retrieval.candidates(_memories(spark, sf_dir), QUERY, repeats=True)
    return got.select("kind", "id", F.round("text_score", 6).alias("text_score"))


@query(CAND_SQL + " SELECT kind, id, round(final, 6) AS score FROM x WHERE final > 0")
def rank_candidates(spark, sf_dir):
    got = retrieval.rank(retrieval.candidates(_memories(spark, sf_dir), QUERY, repeats=True), now())
    return got.select("kind", "id", F.round("score", 6).alias("score"))


@query(CAND_SQL.replace("WITH se", "WITH RECURSIVE se", 1) + """,
o AS (SELECT row_number() OVER (ORDER BY final DESC, kind, id) AS r, kind, id, strlen(content) // 4 AS tokens, final FROM x WHERE final > 0),
w AS (SELECT 0::BIGINT AS r, 400::BIGINT AS room, false AS taken UNION ALL SELECT o.r, CASE WHEN o.tokens <= w.room THEN w.room - o.tokens ELSE w.room END, o.tokens <= w.room FROM w JOIN o ON o.r = w.r + 1)
SELECT kind, id, tokens::BIGINT AS tokens, round(final, 6) AS score FROM o JOIN w USING (r) WHERE taken""")
def retrieve_for_context(spark, sf_dir):
    """The ranked candidates that fit a budget of tokens, taken greedily."""
    return retrieval.context(_memories(spark, sf_dir), QUERY, now(), budget=400, repeats=True).withColumn("score", F.round("score", 6))


# --- further reports ---
EDG_DECAY = decay_sql(CLASS, "recorded_at", TTL, "coalesce(usage_count, 0)", "last_recalled_at")


@query(f"""WITH s AS (SELECT id, relation, {EDG_DECAY} AS v FROM {EDG} WHERE ttl_seconds > 0)
SELECT relation, CASE WHEN v > 0.7 THEN 'keep' WHEN v > 0.3 THEN 'update' ELSE 'expire' END AS action, count(*) AS n, round(avg(v), 6) AS mean FROM s WHERE v < 0.5 GROUP BY ALL""")
def stale_edges(spark, sf_dir):
    """Stale edges by relation and the action they call for."""
    got = lifecycle.stale(once(spark, sf_dir, "edges", "id", "relation", "memory_type", "recorded_at", "ttl_seconds", "usage_count", "last_recalled_at"), now(), created="recorded_at", threshold=0.5)
    return got.groupBy("relation", "action").agg(F.count("*").alias("n"), F.round(F.avg("strength"), 6).alias("mean"))


@query(f"""SELECT source_id, target_id, first(relation ORDER BY coalesce(confidence, 1.0) DESC, recorded_at DESC, id) AS relation, first(id ORDER BY coalesce(confidence, 1.0) DESC, recorded_at DESC, id) AS id FROM {EDG} GROUP BY source_id, target_id""")
def best_relation(spark, sf_dir):
    """The surest relation of each pair of entities, the latest of equal ones."""
    e = once(spark, sf_dir, "edges", "id", "source_id", "target_id", "relation", "confidence", "recorded_at")
    order = [-F.coalesce("confidence", F.lit(1.0)), -seconds("recorded_at"), "id"]
    return learning.best_per(e, ["source_id", "target_id"], order).select("source_id", "target_id", "relation", "id")


@query(f"""WITH c AS (SELECT 'entity' AS kind, id, coalesce(summary, name) AS content, {CLASS} AS memory, {TTL} AS ttl FROM {ENT} UNION ALL SELECT 'edge', id, coalesce(fact, relation), {CLASS}, {TTL} FROM {EDG}
UNION ALL SELECT 'episode', id, content, {CLASS}, {DEFAULT_TTL.format('(' + CLASS + ')')} FROM {EPI})
SELECT kind, memory, count(*) AS n, sum(strlen(content) // 4)::BIGINT AS tokens, count(ttl) AS with_ttl FROM c GROUP BY ALL""")
def candidate_costs(spark, sf_dir):
    """What all memories would cost in tokens, by kind and class."""
    t = tables(spark, sf_dir)
    every = retrieval.entity_candidates(t["entities"]).unionByName(retrieval.edge_candidates(t["edges"])).unionByName(retrieval.episode_candidates(t["episodes"]))
    return every.groupBy("kind", "memory").agg(F.count("*").alias("n"), F.sum(tokens_of("content")).alias("tokens"), F.count("ttl").alias("with_ttl"))


@query("""WITH k AS (SELECT lower(alias_name) AS n, min(canonical_id) AS id FROM aliases WHERE canonical_id IS NOT NULL AND alias_name IS NOT NULL GROUP BY 1), e AS (SELECT lower(name) AS n, min(id) AS id FROM entities WHERE name IS NOT NULL GROUP BY 1)
SELECT a.alias_id, coalesce(k.id, e.id) AS id, CASE WHEN k.id IS NOT NULL THEN 'alias' WHEN e.id IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM aliases a LEFT JOIN k ON k.n = lower(a.alias_name) LEFT JOIN e ON e.n = lower(a.alias_name) WHERE a.canonical_id IS NULL""")
def find_by_alias(spark, sf_dir):
    """Unresolved names looked up among aliases, then among entity names, in any letter case."""
    a, e = load(spark, sf_dir, "aliases"), load(spark, sf_dir, "entities")
    k = a.filter("canonical_id IS NOT NULL AND alias_name IS NOT NULL").groupBy(F.lower("alias_name").alias("_n")).agg(F.min("canonical_id").alias("by_alias"))
    n = e.filter("name IS NOT NULL").groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("by_name"))
    got = a.filter("canonical_id IS NULL").select("alias_id", F.lower("alias_name").alias("_n")).join(k, "_n", "left").join(n, "_n", "left")
    how = F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return got.select("alias_id", F.coalesce("by_alias", "by_name").alias("id"), how.alias("how"))


@query(f"""WITH d AS (SELECT id, {words_sql('content')} AS w FROM {EPI}), t AS (SELECT id, unnest(list_distinct(w)) AS term FROM d), n AS (SELECT count(*) AS total FROM d)
SELECT term, count(*) AS docs, round(ln((total - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term, total HAVING count(*) >= 20""")
def term_statistics(spark, sf_dir):
    """Documents and weight of each term that at least twenty episodes have."""
    d = once(spark, sf_dir, "episodes", "id", "content").select("id", terms("content").alias("w"))
    total = d.agg(F.count("*").alias("total"))
    t = d.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("docs")).filter("docs >= 20")
    return t.join(F.broadcast(total)).select("term", "docs", F.round(F.log((F.col("total") - F.col("docs") + 0.5) / (F.col("docs") + 0.5)), 6).alias("idf"))


@query(f"""WITH t AS (SELECT DISTINCT id, entity_type AS type FROM entities WHERE entity_type IS NOT NULL), e AS (SELECT DISTINCT id, source_id, target_id, relation, recorded_at FROM edges),
p AS (SELECT least(s.type, d.type) AS a, greatest(s.type, d.type) AS b, count(*) FILTER (relation IN ('fixed', 'resolved', 'success')) AS ok, count(*) FILTER (relation IN ('deprecated', 'failed', 'abandoned')) AS bad,
  count(*) FILTER (relation IN ('fixed', 'resolved', 'success', 'deprecated', 'failed', 'abandoned') AND recorded_at < {AT}) AS old FROM e JOIN t s ON s.id = e.source_id JOIN t d ON d.id = e.target_id GROUP BY 1, 2),
m AS (SELECT o.a AS oa, o.b AS ob, n.a, n.b, n.ok / (n.ok + n.bad) AS conf FROM p o JOIN p n ON o.a IN (n.a, n.b) OR o.b IN (n.a, n.b) WHERE o.old > 0 AND n.ok + n.bad > 0)
SELECT 'old|' || oa || '|' || ob AS old_id, first('new|' || a || '|' || b ORDER BY conf DESC, 'new|' || a || '|' || b DESC) AS superseded_by FROM m GROUP BY oa, ob""")
def superseded_skills(spark, sf_dir):
    """Skills made of the edges up to a time, and the surest one of now that shares a type with each."""
    e, ents = load(spark, sf_dir, "edges"), load(spark, sf_dir, "entities")
    named = lambda df, k: df.select(F.concat_ws("|", F.lit(k), "a", "b").alias("id"), F.array("a", "b").alias("entity_types"), "confidence")
    old = named(learning.skills(e.filter(F.col("recorded_at") < F.lit("2023-06-01").cast("timestamp")), ents), "old").withColumn("superseded_by", F.lit(None).cast("string"))
    return learning.supersede(named(learning.skills(e, ents), "new"), old)


@query(_reach_sql(2, "SELECT min(id) AS s FROM entities WHERE entity_type = 'Database'").replace(" SELECT seed, id, min(depth)", ", n AS (SELECT DISTINCT id FROM r2) SELECT e.id, e.source_id, e.relation, e.target_id FROM (SELECT DISTINCT id, source_id, relation, target_id FROM edges WHERE valid_until IS NULL) e WHERE e.source_id IN (FROM n) AND e.target_id IN (FROM n) --"))
def traverse_edges(spark, sf_dir):
    """The current edges among all that lies within two steps of one entity."""
    e = once(spark, sf_dir, "edges", "id", "source_id", "relation", "target_id", "valid_until")
    start = load(spark, sf_dir, "entities").filter("entity_type = 'Database'").agg(F.min("id").alias("seed"))
    return graph.induced(graph.current(e), graph.traverse(e, start, depth=2)).select("id", "source_id", "relation", "target_id")


@query(f"""SELECT kind, key, CASE WHEN length(d) <= 40 THEN d ELSE regexp_replace(d[:40], '\\s+\\S*$', '') END AS description FROM (
SELECT kind, key, replace(key, '|', CASE kind WHEN 'triplet' THEN ' ' ELSE ' and ' END) || ' (' || array_to_string(string_split(types, ','), ', ') || '), in ' || episodes || ' episodes' AS d FROM ({SQL['mined_patterns']}))""")
def described_patterns(spark, sf_dir):
    """Mined patterns with the label under which they are stored, cut at a word's end."""
    t = tables(spark, sf_dir, episodes=("id", "source"), entities=("id", "name", "entity_type"), edges=("id", "source_id", "target_id", "relation", "valid_until", "episode_id"))
    got = learning.patterns(t["episodes"], t["episode_entities"], t["entities"], t["edges"], least=2, least_types=1, most=50)
    return learning.described(got, most=40).select("kind", "key", "description")


@query("SELECT entity_type, name, min(id) AS id FROM entities WHERE name IS NOT NULL AND entity_type IS NOT NULL GROUP BY ALL")
def entity_by_name_and_type(spark, sf_dir):
    """The entity that an exact name of a type means: the first by id."""
    return load(spark, sf_dir, "entities").dropna(subset=["name", "entity_type"]).groupBy("entity_type", "name").agg(F.min("id").alias("id"))


@query(f"SELECT id, source_id, target_id, relation, episode_id FROM (SELECT DISTINCT id, source_id, target_id, relation, episode_id FROM edges) WHERE episode_id IN (SELECT id FROM episodes WHERE source = 'slack')")
def edges_of_episodes(spark, sf_dir):
    """Edges whose provenance is an episode of one source."""
    e = once(spark, sf_dir, "edges", "id", "source_id", "target_id", "relation", "episode_id")
    return graph.edges_of_episodes(e, load(spark, sf_dir, "episodes").filter("source = 'slack'").select("id"))


SCOPED = f"""(SELECT a || '|' || b AS id, description, confidence, CASE WHEN success_count > failure_count THEN 'shared' ELSE 'private' END AS scope, a AS agent FROM ({SKILLS_SQL}))"""


def _scoped(spark, sf_dir):
    """Skills as they would be stored: more successes than failures are shared, the others are the first type's own."""
    got = learning.skills(load(spark, sf_dir, "edges"), load(spark, sf_dir, "entities"))
    scope = F.when(F.col("success_count") > F.col("failure_count"), "shared").otherwise("private")
    return got.select(F.concat_ws("|", "a", "b").alias("id"), "description", F.round("confidence", 8).alias("confidence"), scope.alias("scope"), F.col("a").alias("created_by_agent"), F.lit(None).cast("string").alias("superseded_by"))


@query(f"SELECT id, scope, confidence FROM {SCOPED} WHERE scope = 'shared' OR agent = 'Component'")
def visible_skills(spark, sf_dir):
    """Skills that one agent sees: shared ones and its own."""
    return learning.visible(_scoped(spark, sf_dir), "Component").select("id", "scope", "confidence")


@query(f"SELECT id, greatest(score, 0.8) AS score FROM ({bm25_sql(SCOPED, ['id', 'description'], [word_sql('service')], 'f0 > 0')}) WHERE id IN (SELECT id FROM {SCOPED} WHERE scope = 'shared' OR agent = 'Component')")
def skills_for_context(spark, sf_dir):
    """Visible skills among the hits of a text search over all skills, never below 0.8."""
    every = _scoped(spark, sf_dir)
    hits = search.top(search.bm25(every, "service", ["id", "description"], id="id"), 20, id="id")
    seen = hits.join(learning.visible(every, "Component").select("id"), "id", "left_semi")
    return seen.select("id", F.greatest(F.round("score", 6), F.lit(0.8)).alias("score"))


@query(f"""WITH s AS (SELECT id, {ENT_DECAY} AS v FROM {ENT} WHERE ttl_seconds > 0 AND epoch_us({T}) - epoch_us(created_at) > 7776000000000)
SELECT id, round(v, 6) AS strength FROM s WHERE v < 0.5""")
def stale_prefilter(spark, sf_dir):
    """Stale entities that are also old in days, whatever their time to live."""
    e = once(spark, sf_dir, "entities", "id", "memory_type", "created_at", "ttl_seconds", "usage_count", "last_recalled_at")
    return lifecycle.stale(e, now(), created="created_at", threshold=0.5, prefilter=True).select("id", F.round("strength", 6).alias("strength"))


OLD_EPISODES = "TIMESTAMPTZ '2023-01-01 00:00:00+00'"


@query(f"SELECT DISTINCT id, source FROM {EPI} n WHERE id NOT IN (SELECT id FROM episodes WHERE recorded_at < {OLD_EPISODES} AND id IS NOT NULL)")
def insert_episodes(spark, sf_dir):
    """Insert or ignore by id: the episodes that those recorded before a time don't have yet, each once."""
    e = load(spark, sf_dir, "episodes").select("id", "source", "recorded_at")
    old = e.filter(F.col("recorded_at") < F.lit("2023-01-01").cast("timestamp")).select("id")
    return e.select("id", "source").distinct().join(old, "id", "left_anti")


@query(f"""WITH s AS (SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM {EPI} GROUP BY 1) SELECT string_agg(source || '=' || n, ',' ORDER BY source) AS sources, sum(n)::BIGINT AS episodes FROM s""")
def stats_sources(spark, sf_dir):
    """Episodes by source in one row."""
    s = once(spark, sf_dir, "episodes", "id", "source").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    row = F.struct("source", F.concat("source", F.lit("="), F.col("n").cast("string")).alias("x"))
    return s.agg(F.array_join(F.array_sort(F.collect_list(row))["x"], ",").alias("sources"), F.sum("n").alias("episodes"))
