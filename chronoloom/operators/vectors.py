"""Vector search by cosine: one query, or a stated set of queries against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.columns import cosine, terms


def similar(df: DataFrame, vector: list[float], *, embedding: str) -> DataFrame:
    """Adds ``similarity`` to one query vector."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    return df.withColumn("similarity", cosine(embedding, q))


def hashed_embedding(df: DataFrame, text: str, *, dims: int = 64, out: str = "embedding") -> DataFrame:
    """A bag of hashed words, normed: the encoder to use where no model is at hand. Wordless texts give zeros."""
    slot = F.transform(terms(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter("_slots", lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return (
        df.withColumn("_slots", slot)
        .withColumn("_v", counts)
        .withColumn(out, F.transform("_v", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))
        .drop("_slots", "_v")
    )


def nearest(df: DataFrame, queries: DataFrame, *, id: str, embedding: str, k: int = 10, block: int = 2048) -> DataFrame:
    """(query_id, ``id``, similarity, rank): the ``k`` rows nearest to each query row, itself excluded, ties by id.

    Queries go out in blocks of ``block`` vectors, a bound on what is
    broadcast; each block meets every batch of rows in one matrix product, and
    a batch passes on its k best per query only. Null vectors and vectors of
    another length than the first query's, by id, are skipped in every block, zero vectors have
    similarity 0.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("i"), F.col(embedding).alias("e")).filter("e IS NOT NULL")
    qs = queries.select(F.col(id).alias("q"), F.col(embedding).alias("e")).filter("e IS NOT NULL")
    kind = df.schema[id].dataType.simpleString()
    blocks = max(1, -(-qs.count() // block))
    qs = qs.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    first = qs.agg(F.min_by(F.size("e"), "q").alias("n")).first().n
    out = None
    for b in range(blocks):
        got = qs.filter(F.col("b") == b).select("q", "e").orderBy("q").collect()
        got = [r for r in got if len(r.e) == first]
        if not got:
            continue
        m = np.array([r.e for r in got], np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((np.array([r.q for r in got]), np.divide(m, n, out=np.zeros_like(m), where=n > 0)))

        def run(batches, sent=sent, dims=first):
            ids, unit = sent.value
            for pdf in batches:
                pdf = pdf[pdf["e"].map(len) == dims]
                if not len(pdf):
                    continue
                v = np.stack(pdf["e"].to_numpy()).astype(np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                sim = unit @ np.divide(v, n, out=np.zeros_like(v), where=n > 0).T
                own = pdf["i"].to_numpy()
                sim[ids[:, None] == own[None, :]] = -np.inf
                keep = np.argsort(own, kind="stable")
                order = keep[np.argsort(-sim[:, keep], axis=1, kind="stable")[:, : k]]
                s = np.take_along_axis(sim, order, axis=1)
                res = pd.DataFrame({"q": np.repeat(ids, order.shape[1]), "i": own[order].ravel(), "s": s.ravel()})
                yield res[np.isfinite(res["s"])]

        part = rows.mapInPandas(run, f"q {kind}, i {kind}, s double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"q {kind}, i {kind}, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "i")
    out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(F.col("q").alias("query_id"), F.col("i").alias(id), F.col("s").alias("similarity"), "rank")
