"""Sharding along a Hilbert curve, so that the files of a shard hold near values in every dimension.

Several metadata dimensions are quantised, each row gets the index of its cell on the curve, and
the rows in the order of that index are cut into runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, settled, table, unwrapped, wrapped

ORDER = 8  # bits of a dimension


def hilbert(cells: np.ndarray, bits: int = ORDER) -> np.ndarray:
    """The index on the curve of each row of cells (n x dimensions, each 0 to 2**bits - 1).

    Gray decoding of transposed coordinates (Skilling, 2004), for all rows at once.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def quantised(column: Column, kind: str, bits: int = ORDER) -> Column:
    """A dimension's cell: numbers by their logarithm (eighths of a doubling), other values by hash; null is cell 0."""
    most = (1 << bits) - 1
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        cell = F.least(F.lit(most), F.floor(8 * F.log2(F.greatest(column.cast("double"), F.lit(0.0)) + 1)).cast("int"))
    else:
        cell = F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(most)).cast("int") + 1
    return F.coalesce(cell, F.lit(0)).cast("int")


def shards(rows: DataFrame, dimensions: list[str], n: int, ties: list[str]) -> DataFrame:
    """Add ``curve`` (index), ``shard`` (0 to n - 1) and ``slot`` (from 0, without gaps, in a shard).

    Counts of shards differ by one at most. Rows of one cell follow each other by ``ties``, whose
    last column should tell all rows apart; repeated rows take places of their own, with nulls
    first, and a null dimension is a cell of its own. With fewer rows than shards some stay empty; an
    empty table gives an empty one. Columns of those three names are replaced, others stay whatever
    their names. rows should be narrow: a very long text is moved as often as its row, so put texts to
    their shards by key afterwards.
    """
    kinds, whole = dict(rows.dtypes), rows
    rows = wrapped(rows).select("_in", *(F.col("_in").getField(c).alias(f"_d{i}") for i, c in enumerate(dimensions)), *(F.col("_in").getField(c).alias(f"_t{i}") for i, c in enumerate(ties)))

    @F.pandas_udf("long")
    def curve(cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.array(cells.tolist(), np.int64).reshape(len(cells), len(dimensions))))

    placed = rows.withColumn("curve", curve(F.array(*(quantised(F.col(f"_d{i}"), kinds[d]) for i, d in enumerate(dimensions)))))
    placed = settled(placed, "curve")
    total = placed.count()
    at = ranked(placed, [F.col("curve"), *(F.col(f"_t{i}") for i in range(len(ties)))], "_rank")
    # shard s begins at ceil(s * total / n)
    at = at.withColumn("shard", F.expr(f"cast((_rank * {n}) div {max(1, total)} as int)"))
    at = at.withColumn("slot", F.expr(f"_rank - ((cast(shard as bigint) * {total} + {n - 1}) div {n})"))
    return unwrapped(at, whole, curve="curve", shard="shard", slot="slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by lang, source and size. Equal texts take the dimensions of the
    one with the smallest doc_id, so that a group of copies is one run; only a cut may part it: the law
    leaves a cut no more than one row to move, so where a group of copies lies across it, it is parted."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("_text"))
    narrow = settled(narrow, "narrow")
    first = settled(narrow.groupBy("_text").agg(F.min_by(F.struct("lang", "source"), "doc_id").alias("_d")).select("_text", F.col("_d.lang").alias("_lang"), F.col("_d.source").alias("_source")), "first")
    placed = shards(narrow.join(first, "_text"), ["_lang", "_source", "size"], 24, ["_text", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
