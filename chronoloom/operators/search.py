"""Ranked full-text search (BM25) over any text columns, and fusion of rankings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronoloom.functions.columns import MARKED, BARE, terms

K1, B = 1.2, 0.75
_FOLD = str.maketrans(MARKED, BARE)


@dataclass
class Match:
    """What a row must contain: every unit of ``all``, one of each group of ``any``, none of ``none``.

    A unit is (words, prefix, column): one word, or several for a phrase; with
    ``prefix`` the last word may go on; with ``column`` only that column counts.
    """

    all: list = field(default_factory=list)
    any: list = field(default_factory=list)
    none: list = field(default_factory=list)

    def units(self) -> list:
        return list(dict.fromkeys(self.all + [u for g in self.any for u in g]))


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[\W_]+", text.translate(_FOLD).lower()) if w)


def match(query: str) -> Match:
    """Reads words (all must occur), "phrases", prefix*, column:word, and AND, OR, NOT between them. Never fails."""
    parts = re.findall(r'(?:\w+:)?"[^"]*"|\S+', query)
    m, join, negate = Match(), False, False
    for p in parts:
        if p in ("AND", "OR", "NOT"):
            join, negate = p == "OR" and bool(m.all or m.any), p == "NOT"
            continue
        column, _, rest = p.partition(":") if re.match(r"[a-z]\w*:.", p) else (None, "", p)
        words = words_of(rest)
        if words:
            quoted = rest.startswith('"')
            units = [(words, False, column)] if quoted else [((w,), rest.endswith("*") and w == words[-1], column) for w in words]
            if negate:
                m.none += units
            elif join:
                group = m.any.pop() if m.any and not m.all else [m.all.pop()] if m.all else []
                m.any.append(group + units)
            else:
                m.all += units
        join = negate = False
    return m


def _hits(unit, doc: Column, by_column: dict[str, Column]) -> Column:
    """How often a unit occurs in an array of words."""
    words, prefix, column = unit
    doc = by_column.get(column, doc) if column else doc
    fits = lambda x, i: x.startswith(words[i]) if prefix and i == len(words) - 1 else x == words[i]
    if len(words) == 1:
        return F.size(F.filter(doc, lambda x: fits(x, 0)))
    here = lambda x, i: reduce(lambda a, b: a & b, (F.coalesce(fits(F.get(doc, i + k), k), F.lit(False)) for k in range(len(words))))
    return F.size(F.filter(doc, here))


def bm25(df: DataFrame, query: str | Match, columns: list[str], *, id: str, k1: float = K1, b: float = B, repeats: bool = False) -> DataFrame:
    """``id`` and ``score`` of every row that matches, larger is better.

    A row's document is all of ``columns``; a term's weight is
    ln((N - n + 0.5) / (n + 0.5)), a millionth where that isn't positive; a
    phrase is one term, excluded terms add nothing. Two passes over the table:
    one global aggregate (N, mean length, n of each term: one row), then the
    scores; nothing is shuffled but that row. With ``repeats`` rows that occur
    more than once count once: ids and counts are shuffled for it, texts never.
    An empty query or table gives no rows, null texts are empty.
    """
    q = match(query) if isinstance(query, str) else query
    units = q.units()
    if not units:
        return df.select(F.col(id), F.lit(0.0).alias("score")).limit(0)
    # a column's words are looked at one by one only if the query names a column
    named = {u[2] for u in [*units, *q.none] if u[2] in columns}
    docs = df.select(id, terms(*columns).alias("_doc"), *(terms(c).alias(f"_doc_{c}") for c in named))
    by_column = {c: F.col(f"_doc_{c}") for c in named}
    counted = docs.select(
        id,
        F.size("_doc").alias("_len"),
        *(_hits(u, F.col("_doc"), by_column).alias(f"_f{i}") for i, u in enumerate(units)),
        *(_hits(u, F.col("_doc"), by_column).alias(f"_x{i}") for i, u in enumerate(q.none)),
    )
    counted = counted.distinct() if repeats else counted
    stats = counted.agg(
        F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(units)))
    )
    at = {u: i for i, u in enumerate(units)}
    has = lambda u: F.col(f"_f{at[u]}") > 0
    ok = [has(u) for u in q.all] + [reduce(lambda x, y: x | y, map(has, g)) for g in q.any] + [F.col(f"_x{i}") == 0 for i in range(len(q.none))]
    hit = counted.filter(reduce(lambda x, y: x & y, ok)).join(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(units)):
        n, f = F.col(f"_n{i}"), F.col(f"_f{i}").cast("double")
        idf = F.log((F.col("_n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
        parts.append(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_len") / F.col("_avg"))))
    return hit.select(id, reduce(lambda x, y: x + y, parts).alias("score"))


def top(df: DataFrame, k: int, *, id: str, score: str = "score") -> DataFrame:
    """The ``k`` best, ties by id."""
    return df.orderBy(F.desc(score), id).limit(k)


def ranked(df: DataFrame, *, id: str, score: str = "score", most: int) -> DataFrame:
    """The ``most`` best rows with their 1-based ``rank`` by score, ties by id; bounded before the window."""
    return top(df, most, id=id, score=score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id)))


def ranks_of(df: DataFrame, few: DataFrame, *, id: str, score: str) -> DataFrame:
    """(``id``, ``rank``): the 1-based ranks that a bounded number of rows (``few``, with ``score``) have among all of ``df``, ties by id.

    Every row of ``df`` is placed between two of the few by binary search and
    the rows of each place are counted, so nothing is sorted and no task sees
    more than its own rows; null scores are skipped on both sides.
    """
    spark = df.sparkSession
    rows = sorted({(-r[1], r[0]) for r in few.select(id, score).filter(F.col(score).isNotNull()).collect()})
    kind = df.schema[id].dataType
    if not rows:
        return spark.createDataFrame([], StructType([StructField(id, kind), StructField("rank", LongType())]))
    shared = spark.sparkContext.broadcast((np.array([x for x, _ in rows]), np.array([i for _, i in rows], dtype=object)))

    @F.pandas_udf("int")
    def place(i: pd.Series, x: pd.Series) -> pd.Series:
        """How many of the few are better."""
        scores, ids = shared.value
        x, i = -x.to_numpy(np.float64), i.to_numpy(dtype=object)
        lo, hi = np.searchsorted(scores, x, "left"), np.searchsorted(scores, x, "right")
        for a in np.unique(lo[lo < hi]):
            own = np.flatnonzero((lo == a) & (lo < hi))
            lo[own] += np.searchsorted(ids[a : hi[own[0]]], i[own], "left")
        return pd.Series(lo.astype(np.int32))

    sizes = df.filter(F.col(score).isNotNull()).groupBy(place(id, score).alias("at")).agg(F.count("*").alias("n")).collect()
    n = np.zeros(len(rows) + 1, np.int64)
    for r in sizes:
        n[r.at] = r.n
    return spark.createDataFrame([(i, int(k)) for (_, i), k in zip(rows, np.cumsum(n))], StructType([StructField(id, kind), StructField("rank", LongType())]))


def fused(text: DataFrame, vectors: DataFrame, *, id: str, limit: int, keep: DataFrame | None = None, similarity: str = "similarity", k: int = 60) -> DataFrame:
    """The ``limit`` best rows by fused ranks of text hits (``score``) and of all vectors (``similarity``); ``keep`` filters rows, not ranks.

    A row outside the text leg scores by its vector rank alone, so of those
    only the best can be in the result. The pool thus is the text leg, at most
    ten times the limit or 200, and as many of the nearest vectors; exact vector
    ranks are found for that pool only.
    """
    leg = ranked(text, id=id, most=max(10 * limit, 200)).select(id, "rank")
    leg = leg.sparkSession.createDataFrame(leg.collect(), leg.schema)  # bounded by the leg's size, and read several times
    only = (lambda df: df.join(keep.select(id).distinct(), id, "left_semi")) if keep is not None else (lambda df: df)
    leg = only(leg)
    near = top(only(vectors), limit + max(10 * limit, 200), id=id, score=similarity)
    pool = near.select(id, similarity).unionByName(vectors.join(F.broadcast(leg.select(id)), id, "left_semi").select(id, similarity)).distinct()
    return top(fuse([leg, ranks_of(vectors, pool, id=id, score=similarity)], id=id, k=k), limit, id=id)


def fuse(legs: list[DataFrame], *, id: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the legs (``id``, ``rank``) in which a row occurs."""
    every = reduce(DataFrame.unionByName, [leg.select(id, (1.0 / (k + F.col("rank"))).alias("part")) for leg in legs])
    return every.groupBy(id).agg(F.sum("part").alias("score"))
