"""What several corpus operators share: the cut of a lineage, ranks, components, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A temporary one only where that is unset and driver and executors
    are one process; elsewhere executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost
    executor costs no more than a re-read. The folder can go when the application ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wrapped(df: DataFrame) -> DataFrame:
    """The caller's columns in one struct ``_in``, so that no helper column can clash with one of them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_in"))


def unwrapped(df: DataFrame, of: DataFrame, **added: Column | str) -> DataFrame:
    """The columns of ``of`` out of ``_in`` again, with others added; those of the same name are replaced."""
    lowered = {a.lower() for a in added}
    own = [F.col("_in").getField(c).alias(c) for c in of.columns if c.lower() not in lowered]
    return df.select(*own, *((F.col(c) if isinstance(c, str) else c).alias(a) for a, c in added.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """Add the row's place from 0 in the order of keys, over the whole table.

    Rows are dealt by range and sorted within their ranges; the rows of each range are then
    counted, so only as many counts as there are ranges meet in one place. The ranged rows are
    written first: sampling a second time would deal them otherwise. The last key should tell
    all rows apart, else a large tie stays in one range. df should be narrow.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = settled(dealt, "ranked")
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = starts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_row")).drop("_range", "_row", "_start")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id in edges (a, b) the smallest id that links reach.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until the edges stand
    still; each step is a grouped minimum and a join, so no neighbourhood is gathered.
    """
    now = settled(edges.select("a", "b").where("a <> b").distinct(), "edges")
    n = now.count()
    if not n:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    parts = 8 + n // 100_000  # no step makes more rows than twice the edges

    def step(df: DataFrame, name: str) -> DataFrame:
        return settled(df.coalesce(parts), name)

    mark = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = step(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = step(large.distinct(), "large")
        least = step(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = step(small.where("u <> v").distinct().toDF("a", "b"), "edges")
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.union(now.select("b", "b").toDF("id", "component").distinct())


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the words met of late; holds 400,000 at most."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width values, in order."""
    n, out = len(h) - width + 1, np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mixed(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting: numpy's own way by hashing is many times slower on integers."""
    out = np.sort(values)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join what the links a-b join."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            own = label != np.arange(len(names))
            return names[own], names[label[own]]
        label = new


def among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among sorted_keys."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def rows_per(n: int, each: int, least: int = 128) -> int:
    """Into how many blocks n rows go, each rows a block."""
    return max(least, -(-n // each))


def texts_of(batch, name: str = "text") -> Iterable[bytes]:
    """The UTF-8 bytes of a column of an Arrow batch; null gives empty bytes."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]
