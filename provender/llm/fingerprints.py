"""SimHash fingerprints, and the search of all fingerprints within a Hamming radius.

Each pair of neighbouring words is a term; a term's hash votes on every bit of the fingerprint as
often as the term stands there, and the sign of each sum is the bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, mixed, rows_per, settled, table, unwrapped, wrapped

BITS = 128
#: A copy with a share e of its terms changed is some BITS * arccos(1 - e) / pi bits away: 3 bits are a quarter
#: per cent, 9 bits two and a half. With radius r a block has BITS / (r + 1) bits, so that n prints and q queries
#: make some (r + 1) q n / 2 ** (BITS / (r + 1)) comparisons: 3 suits any table, 7 up to some 10 million prints.
RADIUS = 3


def fingerprint_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The BITS / 8 bytes of a text's fingerprint. Words are runs without ASCII white space; a
    single word is a term of its own; without words all bits are 0."""
    h = hashes.of(text.split())
    if not len(h):
        return np.zeros(BITS // 8, np.uint8)
    terms = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(terms), 4096):
        part = terms[i : i + 4096]
        for k in range(BITS // 64):
            bits = np.unpackbits(mixed(part + np.uint64(k)).view(np.uint8).reshape(-1, 8), axis=1)
            votes[k * 64 : k * 64 + 64] += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(terms))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine that the share of equal bits stands for, 0 at least: 1 for equal fingerprints."""
    apart = int(np.unpackbits(a ^ b).sum())
    return max(0.0, float(np.cos(np.pi * apart / BITS))) if apart else 1.0


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each whole text, in hex; null counts as empty, and a column of that name is replaced."""

    hashes = WordHashes()  # each task fills its own

    @F.pandas_udf("string")
    def hexed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t or b"", hashes).tobytes().hex() for t in texts], dtype=object)

    return docs.withColumn(name, hexed(F.col(text).cast("binary")))


def distance(a: str, b: str) -> Column:
    """In how many bits two columns of hex fingerprints differ."""
    parts = [[F.conv(F.substring(c, i + 1, 8), 16, 10).cast("long") for i in range(0, BITS // 4, 8)] for c in (a, b)]
    return reduce(add, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(*parts))).cast("int")


def near_kinds(queries: DataFrame, prints: DataFrame, radius: int, fingerprint: str = "fingerprint", salts: int = 16) -> DataFrame:
    """(_a, _b, distance) of distinct fingerprints of queries and of prints within ``radius`` bits.

    The bits are cut into radius + 1 blocks: fingerprints within the radius agree on one of them.
    Table k is the fingerprint turned so that block k leads; each distinct fingerprint stands in
    each table once with its block as key, so copies aren't compared one by one. A pair counts in
    the first table that brings it together. A block that many prints share is dealt out ``salts``
    ways, each of which sees all of its queries. Null fingerprints link with nothing; other columns
    aren't looked at; empty tables give an empty one.
    """
    width = BITS // 4  # hex digits
    cuts = [round(i * width / (radius + 1)) for i in range(radius + 2)]

    def block(name: str, k: int) -> Column:
        return F.substring(name, cuts[k] + 1, cuts[k + 1] - cuts[k])

    def spread(df: DataFrame, name: str, salt: Column) -> DataFrame:
        kinds = df.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias(name)).distinct()
        return kinds.select(name, salt.alias("salt"), F.array(*(block(name, k) for k in range(radius + 1))).alias("blocks")).select(name, "salt", F.posexplode("blocks").alias("table", "block"))

    first = F.coalesce(*(F.when(block("_a", k) == block("_b", k), k) for k in range(radius + 1)))
    asked = spread(queries, "_a", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    known = spread(prints, "_b", F.expr(f"cast(pmod(xxhash64(_b), {salts}) as int)"))
    pairs = asked.join(known.hint("merge"), ["table", "block", "salt"]).where(first == F.col("table"))
    return pairs.withColumn("distance", distance("_a", "_b")).where(F.col("distance") <= radius).select("_a", "_b", "distance")


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, fingerprint: str = "fingerprint") -> DataFrame:
    """(query_id, doc_id, distance) of all documents within ``radius`` bits of each query.

    Rows of prints with a query's own doc_id, and null fingerprints, link with nothing. Rows that repeat
    and fingerprints that tie come as often as they stand there, so large groups of copies make many
    rows: near_counts doesn't. Empty tables give an empty one.
    """
    found = queries.select(F.col("doc_id").alias("query_id"), F.col(fingerprint).alias("_a")).join(near_kinds(queries, prints, radius, fingerprint), "_a")
    return found.join(prints.select("doc_id", F.col(fingerprint).alias("_b")), "_b").where("query_id <> doc_id").select("query_id", "doc_id", "distance")


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, fingerprint: str = "fingerprint") -> DataFrame:
    """(fingerprint, n_near): for each distinct fingerprint of queries how many other rows of prints are within ``radius`` bits.

    queries are rows of prints, and one of them doesn't count. Repeated rows and ties count one by one;
    null fingerprints are left out; empty tables give an empty one.
    """
    many = prints.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("_b")).agg(F.count("*").alias("_n"))
    return near_kinds(queries, prints, radius, fingerprint).join(many.hint("merge"), "_b").groupBy(F.col("_a").alias(fingerprint)).agg((F.sum("_n") - 1).alias("n_near"))


def with_next(docs: DataFrame, *carry: str, each: int = 1000) -> DataFrame:
    """Add ``next_text`` and ``next_<column>`` of the document with the next smaller doc_id (see neighbours)."""
    out = neighbours(docs, *carry, each=each)
    return out.withColumns({"text": unpacked()("_text").cast("string"), "next_text": unpacked()("_next_text").cast("string")}).drop("_text", "_next_text")


def unpacked():
    @F.pandas_udf("binary")
    def each(data: pd.Series) -> pd.Series:
        return pd.Series([zstandard.decompress(d) for d in data], dtype=object)

    return each


def ranges(keys: DataFrame, each: int) -> tuple[np.ndarray, np.ndarray]:
    """The last (_id, _tie) of ranges of keys with about ``each`` rows, but of no more ranges than twice the
    root of the number of rows: with n rows, some 16 bytes x 2 sqrt(n) come to the driver."""
    rows = keys.count()
    n = max(2, min(rows_per(rows, each), 2 * math.isqrt(rows) + 128))
    ends = keys.repartitionByRange(n, "_id", "_tie").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("_id", "_tie")).alias("e")).select("e.*").orderBy("_id", "_tie").toPandas()
    return ends["_id"].to_numpy(np.int64), ends["_tie"].to_numpy(np.int64)


def range_of(ids: np.ndarray, ties: np.ndarray, end_ids: np.ndarray, end_ties: np.ndarray) -> np.ndarray:
    """The first range whose end isn't below (id, tie), or the one after all."""
    low, high = np.searchsorted(end_ids, ids, "left"), np.searchsorted(end_ids, ids, "right")
    for i in np.unique(ids[high > low]):  # ids in which a range ends are told apart by ties
        at = np.flatnonzero(ids == i)
        a, b = low[at[0]], high[at[0]]
        low[at] = a + np.searchsorted(end_ties[a:b], ties[at], "left")
    return low


def neighbours(docs: DataFrame, *carry: str, derive: Callable[[DataFrame], DataFrame] | None = None, each: int = 1000) -> DataFrame:
    """docs with their text as ``_text`` and that of the next smaller doc_id as ``_next_text``, both
    under zstd, and ``next_<column>``; the last one's next is the first.

    Ranges of ids are dealt out (see ranges), and the first document of each is added to the range
    above it as that one's last neighbour: texts move once, compressed, and only the ends of ranges
    are exchanged. ``derive`` may add columns to be carried. Null ids come last; equal ids go by a
    hash of the text; repeated rows follow each other; very long texts count whole; a single document
    is its own next; an empty table stays empty. Columns with the names given here are replaced,
    others stay whatever their names.
    """
    spark, derive = docs.sparkSession, derive or (lambda df: df)

    def keyed(df: DataFrame) -> DataFrame:
        # downwards: the larger id first, then the smaller hash
        return wrapped(df).withColumns({"_id": F.coalesce(F.col("_in.doc_id").cast("long"), F.lit(-(1 << 63))), "_tie": F.bitwise_not(F.xxhash64("_in.text"))})

    end_ids, end_ties = ranges(keyed(docs).select("_id", "_tie"), each)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids.to_numpy(), ties.to_numpy(), end_ids, end_ties))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([zstandard.compress(t or b"", 1) for t in texts], dtype=object)

    # the ends of ranges are the tops of what is dealt by them; that of the lowest follows the highest's
    tops = list(zip(end_ids.tolist(), end_ties.tolist()))
    follows = [((i + 1) % len(tops), *top) for i, top in enumerate(tops)]
    follows = F.broadcast(spark.createDataFrame(follows, "_of int, _id long, _tie long"))  # one row for each range

    made = derive(docs)
    own = keyed(made).withColumns({"_block": block_of("_id", "_tie"), "_added": F.lit(False)})
    top = keyed(docs).join(follows, ["_id", "_tie"]).groupBy("_of").agg(F.first("_in").alias("_in"))
    added = keyed(derive(top.select("_in.*"))).join(follows, ["_id", "_tie"]).withColumns({"_block": F.col("_of"), "_added": F.lit(True)}).drop("_of")
    moved = own.unionByName(added).withColumn("_text", packed(F.col("_in.text").cast("binary")))
    rest = [c for c in made.columns if c.lower() != "text"]
    moved = moved.select("_block", "_added", "_id", "_tie", "_text", F.struct(*(F.col(f"_in.`{c}`").alias(c) for c in rest)).alias("_in"))
    order = Window.partitionBy("_block").orderBy("_added", F.desc("_id"), F.desc("_tie"))
    out = moved.withColumns({"_next_text": F.lead("_text").over(order), "_next": F.struct(*(F.lead(f"_in.{c}").over(order).alias(c) for c in carry)) if carry else F.lit(None)})
    named = {"_text": F.col("_text"), "_next_text": F.col("_next_text")} | {f"next_{c}": F.col(f"_next.{c}") for c in carry}
    return unwrapped(out.where(~F.col("_added")), made.select(*(f"`{c}`" for c in rest)), **named)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_prints(rows: DataFrame) -> DataFrame:
    """Add ``edited`` (bytes) and its ``edited_fingerprint`` to what neighbours gives; columns of those names are replaced."""
    hashes = WordHashes()

    @F.pandas_udf("edited binary, edited_fingerprint string")
    def make(texts: pd.Series, following: pd.Series) -> pd.DataFrame:
        pairs = ((zstandard.decompress(x).decode() for x in (a, b)) for a, b in zip(texts, following))
        made = [edited(*p).encode() for p in pairs]
        return pd.DataFrame({"edited": made, "edited_fingerprint": [fingerprint_of(t, hashes).tobytes().hex() for t in made]}, dtype=object)

    out = wrapped(rows).withColumn("_e", make("_in._text", "_in._next_text"))
    return unwrapped(out, rows, edited="_e.edited", edited_fingerprint="_e.edited_fingerprint")


def likeness_of(a: str, b: str) -> Column:
    """likeness() of two columns of hex fingerprints."""
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(F.lit(np.pi / BITS) * distance(a, b))))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``n_near``: for documents whose id is divisible by 100, how many others are within RADIUS bits."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
    docs = edited_prints(neighbours(docs, "fingerprint", derive=fingerprints)).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness_of("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness_of("fingerprint", "next_fingerprint").alias("near_next"),
    )
    docs = settled(docs, "prints")
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    queries = docs.where(asked)
    counted = queries.join(near_counts(queries, docs).hint("merge"), "fingerprint", "left").select(*docs.columns, "n_near")
    return counted.union(docs.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
