"""Session settings, table loading, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that its functions run wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(dir=SparkFiles.getRootDirectory()), f"{here.name}-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, null for null."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """At least as many partitions as the cluster has cores, for stages with heavy work per row.

    A small compressed file often arrives as one partition; a shuffle of it is
    cheaper than one busy core. Nothing moves when the input is split enough.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir``, else (local mode only) a new one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _OWN[sc.applicationId]


def until_exit(spark: SparkSession, path: str) -> str:
    """Has a scratch folder deleted when the driver ends; returns it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    The files survive the loss of executors, unlike cached or locally
    checkpointed blocks, and later reads prune columns. They go with the driver
    at the latest.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a frame made by ``table`` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_scratch", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else a plain frame for a shuffle join.

    The size is checked by fetching no more than ``most + 1`` rows; what was
    fetched becomes the broadcast side, so the aggregate isn't computed twice.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def bounded_side(made: DataFrame, most: int = 20_000) -> DataFrame:
    """A frame made by ``table``, marked for broadcast if it has at most ``most`` rows, else as it is for a shuffle join.

    The rows are counted by the files' footers; unlike in ``small_side`` none
    goes through the driver's Python, which matters for a side of many joins.
    """
    return F.broadcast(made) if made.count() <= most else made


def keyed_side(side: DataFrame, keys: list[str], *, most: int = 20_000, salts: int = 16) -> Callable[[DataFrame, str], DataFrame]:
    """A left join with a side of one row a key that no hot key can clog; returns (frame, count column) -> joined frame.

    A side of at most ``most`` rows is broadcast. A larger one is written and
    joined in two steps: keys that hold over a thousandth of the frame's rows,
    by that definition at most a thousand, are broadcast, all others meet by
    key and one of ``salts`` salts. So no task gets more than a thousandth over
    ``salts`` of the rows for one key, and the side, whose rows stand for many
    rows of the frame each, is repeated only ``salts`` times. The count column
    of the side says how many rows of the frame its key has. Null keys match
    null keys.
    """
    rest = [c for c in side.columns if c not in keys]
    rows = side.limit(most + 1).collect()

    def join(df: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
        other = other.select(*(F.col(c).alias(f"_side_{c}") for c in on), *columns)
        cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_side_{c}")) for c in on))
        return df.join(other, cond, "left").drop(*(f"_side_{c}" for c in on))

    if len(rows) <= most:
        small = F.broadcast(side.sparkSession.createDataFrame(rows, side.schema))
        return lambda df, n: join(df, small, keys, rest)
    whole = table(side, "side")

    def split(df: DataFrame, n: str) -> DataFrame:
        total = whole.agg(F.sum(n)).first()[0] or 0
        hot = whole.filter(F.col(n) > total // 1000)
        hot = F.broadcast(side.sparkSession.createDataFrame(hot.limit(1000).collect(), side.schema))
        cold = whole.filter(F.col(n) <= total // 1000).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        cold = cold.select(*keys, "_salt", F.struct(*rest).alias("_cold"))
        got = join(df, hot.select(*keys, F.struct(*rest).alias("_hot")), keys, ["_hot"])
        spread = F.xxhash64(*(c for c in df.columns if c not in keys))
        got = got.withColumn("_salt", F.when(F.col("_hot").isNull(), F.pmod(spread, F.lit(salts))).otherwise(salts + F.pmod(spread, F.lit(1 << 20))).cast("int"))
        got = join(got, cold, [*keys, "_salt"], ["_cold"])
        return got.select(*df.columns, *(F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in rest))

    return split


def bit_map(keys: DataFrame, key: str, *, most: int = 1 << 27) -> bytes:
    """One bit for each 64-bit key, in a map of at most ``most`` bits (16 MB) for workers to test with ``in_map``.

    A set bit may be another key's, so what it lets through is joined by key; a
    full map costs time, never rows.
    """
    bits, n = 1 << 18, keys.count()
    while bits < min(16 * n, most):
        bits *= 2
    at = F.pmod(key, F.lit(bits))
    rows = keys.select(F.floor(at / 32_768).alias("b"), (at % 32_768).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = bytearray(bits // 8)
    for r in rows:
        out[r.b * 4096 : (r.b + 1) * 4096] = r.m
    return bytes(out)


def in_map(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (64-bit, unsigned) have their bit set."""
    m = np.frombuffer(bits, np.uint8)
    at = keys % np.uint64(8 * len(m))
    return m[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def most_frequent(df: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of the highest counts ``n``, at most ``most``: all that reach a level that so many rows reach.

    The level comes from a histogram of the counts' logarithms, some thousand
    rows at most, so neither sorting nor a task or the driver with more than
    ``most`` rows is needed. Rows of one level stay or go together.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    sizes = df.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for r in sizes:
        total += r.rows
        if total > most:
            return df.filter(level >= least) if least is not None else df.limit(0)
        least = r.level
    return df
