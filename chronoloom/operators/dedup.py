"""Deduplication of new entities against known ones: aliases first, then Jaro-Winkler within a type."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity with Winkler's prefix bonus (4 letters, 0.1 each), given only above 0.7."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used = [False] * lb
    ma = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                ma.append(c)
                break
    m = len(ma)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(ma, (b[j] for j in range(lb) if used[j]))) // 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, la, lb) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def jaro_winkler_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def _shapes(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, letters counted in 64 slots, and the first four letters of each name."""
    letters, heads = np.zeros((len(names), 64), np.int16), np.zeros((len(names), 4), np.int32)
    for i, x in enumerate(names):
        codes = np.array([ord(c) for c in x], np.int64)
        np.add.at(letters[i], codes % 64, 1)
        heads[i, : min(4, len(codes))] = codes[:4]
    return np.array([len(x) for x in names]), letters, heads


def _possible(name: str, size: np.ndarray, letters: np.ndarray, heads: np.ndarray, least: float) -> np.ndarray:
    """Which names can reach ``least``: Jaro's matches are at most the letters in common, Winkler's bonus is known from the heads."""
    (n,), own, head = _shapes([name])
    common = np.minimum(letters, own[0]).sum(axis=1)
    prefix = np.cumprod((heads == head[0]) & (head[0] > 0), axis=1).sum(axis=1)
    jaro = (common / np.maximum(size, 1) + common / max(n, 1) + 1) / 3
    return (jaro + prefix * 0.1 * (1 - jaro) >= least - 1e-9) & (size > 0) & (n > 0)


def normal_name(c: str):
    """A name as it is compared: without outer spaces, in small letters."""
    return F.trim(F.lower(c))


def most_alike(new: DataFrame, known: DataFrame, *, least: float = 0.85, block: int = 5000) -> DataFrame:
    """(id, match_id, similarity): for each new (id, name, type) the most alike known entity of its type, ties by id.

    The new rows are the stated query set: they go out by type in blocks of
    ``block``, so known rows are never shuffled. Names are compared one by one
    only where the letters that both have, counted for all new names at once,
    allow the threshold. Both sides are distinct names of a type first
    (``normal_name``), however many rows have them.
    """
    spark = known.sparkSession
    every = new.select("id", normal_name("name").alias("name"), "type").dropna().distinct()
    n = every.select(F.xxhash64("name", "type").cast("string").alias("id"), "name", "type").distinct()
    blocks = max(1, -(-n.count() // block))
    n = n.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    rows = known.select(F.col("id").alias("match_id"), normal_name("name").alias("match_name"), "type").dropna()
    rows = rows.groupBy("match_name", "type").agg(F.min("match_id").alias("match_id"))
    out = None
    for b in range(blocks):
        got = n.filter(F.col("_b") == b).select("id", "name", "type").collect()
        by: dict = {}
        for r in got:
            by.setdefault(r.type, []).append((r.id, r.name))
        sent = spark.sparkContext.broadcast({t: (x, *_shapes([name for _, name in x])) for t, x in by.items()})

        def run(batches, sent=sent):
            for pdf in batches:
                best: dict = {}
                for typ, part in pdf.groupby("type", sort=False):
                    if typ not in sent.value:
                        continue
                    new, size, letters, heads = sent.value[typ]
                    for mid, name in zip(part["match_id"], part["match_name"]):
                        for j in np.flatnonzero(_possible(name, size, letters, heads, least)):
                            i, x = new[j]
                            s = jaro_winkler(x, name)
                            if s >= least and (i not in best or (-s, mid) < (-best[i][1], best[i][0])):
                                best[i] = (mid, s)
                yield pd.DataFrame([(i, m, s) for i, (m, s) in best.items()], columns=["id", "match_id", "similarity"])

        part = rows.mapInPandas(run, "id string, match_id string, similarity double")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("id").agg(F.max("similarity").alias("similarity"), F.min_by("match_id", F.struct(-F.col("similarity"), F.col("match_id"))).alias("match_id"))
    best = n.join(best, "id").select("name", "type", "match_id", "similarity")
    return every.join(best, ["name", "type"]).select("id", "match_id", "similarity")


def resolve(new: DataFrame, known: DataFrame, aliases: DataFrame, *, least: float = 0.85) -> DataFrame:
    """(id, canonical_id, how): an alias of that name (any type, the least canonical id), else the most alike of its type, else itself.

    All rows of a batch see the entities known before it, not one another.
    """
    al = aliases.filter("canonical_id IS NOT NULL").select(normal_name("alias_name").alias("_n"), "canonical_id").groupBy("_n").agg(F.min("canonical_id").alias("by_alias"))
    got = new.select("id", "name", "type").distinct().withColumn("_n", normal_name("name")).join(al, "_n", "left")
    sim = most_alike(got.filter("by_alias IS NULL"), known, least=least).select("id", F.col("match_id").alias("by_name"))
    got = got.join(sim, "id", "left")
    how = F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_name").isNotNull(), "name").otherwise("new")
    return got.select("id", F.coalesce("by_alias", "by_name", "id").alias("canonical_id"), how.alias("how"))
