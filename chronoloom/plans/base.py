"""Registration of queries with their SQL, and the graph's tables with repeated rows taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.common import load

NOW = "2026-01-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, its key among them, with repeated rows taken once.

    Repeats are equal in all columns. As all columns are grouping keys, filters
    on any of them reach the Parquet scan, and the aggregate can hash.
    """
    df = load(spark, sf_dir, name)
    return df.select(*columns).distinct() if columns else df.distinct()


def tables(spark: SparkSession, sf_dir: str, **columns: tuple[str, ...]) -> dict[str, DataFrame]:
    """The graph's tables, whole or only the columns given for them."""
    out = {n: once(spark, sf_dir, n, *columns.get(n, ())) for n in ("episodes", "entities", "edges", "aliases")}
    out["episode_entities"] = once(spark, sf_dir, "episode_entities", *columns.get("episode_entities", ("episode_id", "entity_id")))
    return out


# --- pieces of SQL for DuckDB ---
T = f"TIMESTAMPTZ '{NOW}+00'"


def flag_sql(key: str, c: str = "metadata") -> str:
    return f"coalesce(lower(CASE WHEN json_valid({c}) THEN json_extract_string({c}, '$.{key}') END) IN ('1', 'true'), false)"


LIVE = f"NOT {flag_sql('marked_for_deletion')}"
CLASS = "CASE WHEN lower(trim(memory_type)) IN ('fact','pattern','experience','preference','decision') THEN lower(trim(memory_type)) ELSE 'fact' END"
TTL = "CASE WHEN ttl_seconds >= 0 THEN ttl_seconds END"
DEFAULT_TTL = "CASE {0} WHEN 'fact' THEN 7776000 WHEN 'experience' THEN 15552000 WHEN 'preference' THEN 2592000 WHEN 'decision' THEN 7776000 END"


def decay_sql(memory: str, created: str, ttl: str, usage: str, recalled: str) -> str:
    age = f"greatest(floor((epoch_us({T}) - epoch_us(CASE WHEN {recalled} > {created} AND {recalled} <= {T} THEN {recalled} ELSE {created} END)) / 1000000), 0)::DOUBLE"
    life = f"(({ttl})::DOUBLE * least(1 + 0.15 * ln(1 + {usage}::DOUBLE), 1.75))"
    return f"""CASE WHEN {memory} = 'pattern' OR ({ttl}) IS NULL THEN 1.0::DOUBLE WHEN ({ttl}) = 0 THEN 0.0
      WHEN {memory} = 'experience' THEN CASE WHEN {age} > {life} THEN 0.0 ELSE greatest(0.0, 1 - {age} / {life}) END
      WHEN {age} > {life} THEN 0.25 * exp(-3 * ({age} - {life}) / {life})
      ELSE exp(-2.0 * ln(2.0) / {life} * {age}) END"""


def words_sql(*columns: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(strip_accents(concat_ws(' ', {', '.join(columns)}))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(source: str, columns: list[str], units: list[str], where: str, limit: int = 20, extra: str = "") -> str:
    """``units``: SQL over the list ``w`` of words that counts each term; ``where``: over f0, f1, ..."""
    counts = ", ".join(f"{u} AS f{i}" for i, u in enumerate(units))
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(units)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(units)))
    return f"""
WITH d AS (SELECT id, {words_sql(*columns)} AS w FROM {source}),
f AS (SELECT id, len(w) AS l, {counts} {extra} FROM d),
s AS (SELECT count(*) AS n, avg(l) AS a, {ns} FROM f)
SELECT id, round({score}, 6) AS score FROM f, s WHERE {where} ORDER BY {score} DESC, id LIMIT {limit}"""


def word_sql(w: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{w}'))"


def phrase_sql(*words: str) -> str:
    tests = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"len(list_filter(range(1, len(w) + 1), lambda i: coalesce({tests}, false)))"
