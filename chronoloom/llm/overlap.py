"""Same or nearly same records across splits: minwise hashes, banded buckets, exact Jaccard."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from chronoloom.common import bit_map, in_map, spread, table
from chronoloom.llm.names import lcs_length
from chronoloom.llm.words import WordHashes, folded


def grams_of(words: list[str], shingle: int, known: WordHashes) -> np.ndarray:
    """32-bit hashes of the runs of ``shingle`` words; a repeat counts as one of its own, so that the set is the multiset."""
    n: dict[str, int] = {}
    out = []
    for i in range(max(len(words) - shingle + 1, 1)):
        w = " ".join(words[i : i + shingle])
        n[w] = c = n.get(w, 0) + 1
        out.append(w if c == 1 else f"{w}#{c}")
    return np.unique(known.of(out).astype(np.uint32))


def wordings(shingle: int):
    """A batch function: (id, split, source, text) to (id, split, source, key of the wording, words, shingle hashes)."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            words = [folded(t) for t in b.column("text").to_pylist()]
            joined = [" ".join(w) for w in words]
            keys = [hashlib.blake2b(w.encode(), digest_size=16).digest() for w in joined]
            grams = [grams_of(w, shingle, known).view(np.int32) for w in words]
            cols = [*b.columns[:-1], pa.array(keys, pa.binary()), pa.array(joined, pa.string()), pa.array(grams, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "k", "words", "grams"])

    return run


def buckets(bands: int, rows: int, only=None, seed: int = 7):
    """A batch function: (n, grams) to (n, h), one row for each band of minwise hashes; with ``only`` (a broadcast map) those in the map."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
    add = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    mix = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    band = rng.integers(1, 2**63, bands, dtype=np.uint64)

    def run(batches):
        for b in batches:
            grams = b.column("grams")
            flat, ends = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint32), grams.offsets.to_numpy()
            ends = ends - ends[0]
            hashes = np.empty((len(ends) - 1, bands), np.uint64)
            for i in range(len(ends) - 1):
                low = np.full(bands * rows, np.uint32(2**32 - 1))
                for at in range(ends[i], ends[i + 1], 512):  # blocks, so that a very long text needs no large matrix
                    low = np.minimum(low, (flat[at : min(at + 512, ends[i + 1]), None] * mul + add).min(axis=0))
                hashes[i] = (low.reshape(bands, rows) * mix).sum(axis=1, dtype=np.uint64) + band
            n, h = np.repeat(b.column("n").to_numpy(zero_copy_only=False), bands), hashes.ravel()
            h ^= h >> np.uint64(29)
            if only is not None:
                there = in_map(only.value, h)
                n, h = n[there], h[there]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(h.view(np.int64))], names=["n", "h"])

    return run


def _jaccard(a: str, b: str) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return inter / (F.size(a) + F.size(b) - inter)


@F.pandas_udf(DoubleType())
def order_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words of the longest common subsequence, twice, over the words of both texts."""
    out = []
    for x, y in zip(a, b):
        x, y = x.split(), y.split()
        out.append(1.0 if x == y else 2 * lcs_length(x, y) / (len(x) + len(y)))
    return pd.Series(out, dtype="float64")


def cross_split_overlaps(
    df: DataFrame,
    *,
    id: str,
    text: str,
    split: str,
    source: str | None = None,
    train: str = "train",
    evaluation: tuple[str, ...] = ("val", "test", "dev"),
    threshold: float = 0.66,
    order: float = 0.8,
    shingle: int = 1,
    bands: int = 48,
    rows: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """Wordings of the training split that occur, the same or nearly so, in an evaluation split.

    Returns ``links`` (k_train, k_eval, jaccard), one row for each pair of
    different or equal wordings, and ``members`` (id, split, source, k), the
    rows of each wording. Copies of one wording are one row until members are
    joined, however many there are.

    Wordings are compared as multisets of ``shingle``-word sequences after
    markers, case, punctuation, accents and the way of encoding are folded. One
    word in six replaced leaves a Jaccard similarity of 5/7 on single words and
    next to nothing on sequences of five, hence the default of one word and
    0.66. Two texts at 5/7 meet in one of 48 buckets of 6 minwise hashes with
    probability 0.9989. Buckets are joined between train and evaluation only,
    candidates are verified exactly. What passes must also agree in its order:
    the longest common subsequence of words, which each changed, added, dropped
    or moved word shortens by one at most, must reach ``order`` of both texts
    (5/6 at one word in six); two texts made of the same sentences in another
    order don't. Null splits and null, empty or wordless texts belong to no pair;
    split names are taken without outer spaces and in any letter case. Repeated rows
    count once, an empty input gives empty results, other columns are ignored.
    """
    side = F.lower(F.trim(split))
    src = F.col(source) if source else F.lit(None).cast("string")
    picked = df.select(F.col(id).alias("id"), side.alias("split"), src.alias("source"), F.col(text).alias("text"))
    picked = spread(picked.filter(F.col("split").isin(train, *evaluation) & F.col("text").isNotNull()))
    kept = StructType([*picked.schema.fields[:-1], StructField("k", BinaryType()), StructField("words", StringType()), StructField("grams", ArrayType(IntegerType()))])
    named = table(picked.mapInArrow(wordings(shingle), kept).filter("words <> ''"), "wordings")
    in_train = F.col("split") == train
    texts = named.groupBy("k").agg(F.first("words").alias("words"), F.first("grams").alias("grams"), F.max(in_train).alias("t"), F.max(~in_train).alias("e"))
    texts = table(texts.withColumn("n", F.monotonically_increasing_id()), "texts")

    # two longs a bucket row; of train only those rows leave the workers whose bucket the evaluation splits may have, too
    cells = lambda side, only=None: spread(texts.filter(side).select("n", "grams")).mapInArrow(buckets(bands, rows, only), "n bigint, h bigint")
    right = table(cells("e"), "buckets")
    left = cells("t", df.sparkSession.sparkContext.broadcast(bit_map(right, "h")))
    met = left.select(F.col("n").alias("a"), "h").join(right.select(F.col("n").alias("b"), "h"), "h").select("a", "b").distinct()
    sure = (
        met.join(texts.select(F.col("n").alias("a"), F.col("grams").alias("ga")), "a")
        .join(texts.select(F.col("n").alias("b"), F.col("grams").alias("gb")), "b")
        .select("a", "b", _jaccard("ga", "gb").alias("jaccard"))
        .filter(F.col("jaccard") >= threshold)
        .join(texts.select(F.col("n").alias("a"), F.col("words").alias("wa")), "a")
        .join(texts.select(F.col("n").alias("b"), F.col("words").alias("wb")), "b")
        .filter(order_ratio("wa", "wb") >= order)
    )
    key = texts.select("n", "k")
    links = sure.join(key.select(F.col("n").alias("a"), F.col("k").alias("k_train")), "a").join(key.select(F.col("n").alias("b"), F.col("k").alias("k_eval")), "b")
    links = links.select("k_train", "k_eval", "jaccard")
    return links, named.select("id", "split", "source", "k").distinct()


def overlap_pairs(links: DataFrame, members: DataFrame, *, train: str = "train") -> DataFrame:
    """Pairs of rows (a, b, a < b) of linked wordings, one of train and one of an evaluation split."""
    t = members.filter(F.col("split") == train).select(F.col("id").alias("x"), F.col("k").alias("k_train"))
    e = members.filter(F.col("split") != train).select(F.col("id").alias("y"), F.col("k").alias("k_eval"))
    got = links.join(t, "k_train").join(e, "k_eval")
    return got.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def overlap_report(links: DataFrame, members: DataFrame, *, train: str = "train") -> DataFrame:
    """Per evaluation split and source: examples that also occur in train, of all, and their pairs.

    Counted by wording and number of members; no pair is written out.
    """
    size = members.filter(F.col("split") == train).groupBy(F.col("k").alias("k_train")).agg(F.countDistinct("id").alias("n"))
    per = links.join(size, "k_train").groupBy(F.col("k_eval").alias("k")).agg(F.sum("n").alias("n_train"))
    ev = members.filter(F.col("split") != train).join(per, "k", "left")
    return ev.groupBy("split", "source").agg(
        F.countDistinct("id").alias("n_examples"),
        F.countDistinct(F.when(F.col("n_train").isNotNull(), F.col("id"))).alias("n_overlapping"),
        F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_pairs"),
    )
