"""Substring dedup: words covered by a window that starts in an earlier document too are removed.

A count-min sketch comes first: ``depth`` rows of counters, in each of which a window has one cell.
Every block of documents makes a sketch of its windows; sketches of all blocks have the same shape and
are merged by adding their counters, so the least of a window's counters is never below its count. Each
block learns which of its counters are above one. Only windows with all their counters above one are
grouped exactly, by 96 bits of hash: no repeated window is lost, and one that is estimated repeated
without being so finds no partner. Counters that are 0 are never stored or sent, and ranges of cells are
merged apart, so a sketch may be as wide as the table asks. Documents are packed into blocks and dealt
once; the three passes over them share that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, mixed, table, windows

WIDTH = 13
#: Rows of the sketch, and cells in each for every window of the table. A window that isn't repeated meets
#: another one in a cell with a probability of at most 1 / CELLS, in all rows with CELLS ** -DEPTH: 1.6 %.
DEPTH, CELLS = 3, 4
OTHER = np.uint64(0xD6E8FEB86659FD93)


def packed(*columns: np.ndarray) -> bytes:
    """Unsigned columns of one length, as byte planes under zstd; the first is sorted and goes by differences."""
    first = np.diff(columns[0], prepend=columns[0][:1] * 0)
    planes = [c.astype(c.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, c.itemsize).T.ravel() for c in (first, *columns[1:])]
    return zstandard.compress(np.concatenate(planes).tobytes(), 1)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, sizes = np.frombuffer(zstandard.decompress(data), np.uint8), [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def parts(key: np.ndarray, n: int, top: int) -> np.ndarray:
    """Where each of n equal ranges of the values below top begins in sorted keys, and the end."""
    edges = np.array([i * top // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(key, edges), [len(key)]]).astype(np.int64)


class Block:
    """The windows of a block of documents: key1 and key2 (hashes), at (first word), doc (row), and of each document its id and whether that is null."""

    def __init__(self, row: pd.Series, width: int):
        self.ids, self.none = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["none"], bool)
        sizes, data = np.frombuffer(row["sizes"], "<i8"), zstandard.decompress(row["data"])
        ends = np.cumsum(sizes)
        self.words = [data[e - n : e].split() for n, e in zip(sizes.tolist(), ends.tolist())]
        n = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(n)
        h = WordHashes().of([x for w in self.words for x in w])
        key1, key2 = windows(h, width), windows(h ^ OTHER, width)
        doc = np.repeat(np.arange(len(n)), n)[: len(key1)]
        self.at = np.flatnonzero(np.arange(width, len(key1) + width) <= self.ends[doc]) if len(key1) else np.zeros(0, np.int64)
        self.key1, self.key2, self.doc = key1[self.at], key2[self.at].astype(np.uint32), doc[self.at]


def counters(key: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """depth x n: the counter of each window in each row of a sketch of 2 ** bits cells a row, as one number."""
    cells = [mixed(key + turn) >> np.uint64(64 - bits) for turn in np.arange(1, depth + 1, dtype=np.uint64) * OTHER]
    return np.array([c * np.uint64(depth) + np.uint64(d) for d, c in enumerate(cells)], np.uint64).reshape(depth, len(key))


def starts(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def blocks_of(docs: DataFrame, size: int) -> DataFrame:
    """(block, ids, none, sizes, data): the documents of a partition in blocks of ``size`` bytes of text, under zstd.

    A longer text is a block alone. The number of a block hangs on its place in the scan. none marks
    documents without an id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[tuple[int, bool]] = []
        texts: list[bytes] = []
        held, n, part = 0, 0, 0

        def out() -> pd.DataFrame:
            row = (part << 24) + n, np.array([i for i, _ in ids], "<i8").tobytes(), np.array([x for _, x in ids], bool).tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.compress(b"".join(texts), 1)
            return pd.DataFrame([row], columns=["block", "ids", "none", "sizes", "data"])

        for pdf in batches:
            for part, i, none, text in zip(pdf["part"], pdf["id"], pdf["none"], pdf["text"]):
                text = text or b""
                if texts and held + len(text) > size:
                    yield out()
                    ids, texts, held, n = [], [], 0, n + 1
                ids.append((i, none))
                texts.append(text)
                held += len(text)
        if texts:
            yield out()

    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("none"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "block long, ids binary, none binary, sizes binary, data binary")


def dedup(docs: DataFrame, width: int = WIDTH, depth: int = DEPTH, cells: float = CELLS, block_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): what is left of each text, its words joined by one space.

    A word goes if a window of ``width`` words covers it whose words also stand in a row in a
    document with a smaller doc_id. Rows with the same id don't take words from one another; a
    null id counts as larger than all. Null and empty texts have no words; texts with fewer words
    than a window stay whole; very long texts count whole; other columns of docs are left out and
    may have any names; an empty table gives an empty one. Three passes read docs, so its rows have to
    come in the same order each time: pass a table read from files, or what ``settled`` returns.

    The sketch has ``depth`` rows of some ``cells`` cells for each window that the table has at most.
    It may be far too small: then more windows are grouped exactly, and none is lost. Blocks hold 1/64
    of the texts' bytes, but 256 kB at least and 4 MB at most, or 1/32768 of all if that is more, so
    that what a block sends to a range of cells stays worth a row.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = block_bytes or max(1 << 18, min(1 << 22, total // 64), total // 32768)
    most = max(1, total // 2)  # windows of one-letter words; texts have some third of that
    bits = max(1, int(np.ceil(np.log2(cells * max(1, most // 3)))))
    top = depth << bits
    shards = max(16, min(most // 3_000_000, size // 400))
    dealt = blocks_of(docs.select("doc_id", "text"), size)
    sent = ["block", "shard", "data"]

    def dealt_out(block: int, key: np.ndarray, end: int, *columns: np.ndarray) -> pd.DataFrame:
        at = parts(key, shards, end)
        full = np.flatnonzero(np.diff(at))
        return pd.DataFrame({"block": block, "shard": full, "data": [packed(*(c[at[i] : at[i + 1]] for c in columns)) for i in full]}, columns=sent)

    def sketch(pdf: pd.DataFrame) -> pd.DataFrame:
        value, n = np.unique(counters(Block(pdf.iloc[0], width).key1, depth, bits), return_counts=True)
        return dealt_out(pdf["block"].iloc[0], value, top, value, np.minimum(n, 2).astype(np.uint8))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block a bit for each of the counters it sent: whether the sum is above one."""
        got = [unpacked(x, "<u8", "u1") for x in pdf["data"]]
        value, place = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        often = np.bincount(place, np.concatenate([g[1] for g in got])) > 1
        ends = np.cumsum([len(g[0]) for g in got])
        bits_of = [np.packbits(often[place[e - len(g[0]) : e]]).tobytes() for g, e in zip(got, ends)]
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "shard": pdf["shard"].to_numpy(), "data": bits_of})

    def candidates(pdf: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or answer.empty:
            return pd.DataFrame(columns=sent)
        b = Block(pdf.iloc[0], width)
        own = counters(b.key1, depth, bits)
        order = np.argsort(own.ravel())
        value = own.ravel()[order]
        new = starts(value)
        value, place = value[new], np.cumsum(new) - 1
        at = parts(value, shards, top)
        often = np.zeros(len(value), bool)
        for shard, data in zip(answer["shard"], answer["data"]):
            often[at[shard] : at[shard + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=at[shard + 1] - at[shard])
        above = np.empty(own.size, bool)
        above[order] = often[place]
        on = above.reshape(own.shape).all(0)
        k1, k2, ids, none = b.key1[on], b.key2[on], b.ids[b.doc[on]], b.none[b.doc[on]]
        order = np.lexsort((ids, none, k2, k1) if none.any() else (ids, k2, k1))
        k1, k2, ids, none = k1[order], k2[order], ids[order], none[order]
        first = np.flatnonzero(starts(k1, k2))
        last = np.concatenate([first[1:], [len(k1)]])[: len(first)] - 1
        low = ids[first].view(np.uint64)
        # of documents without an id: none, the last, all
        flag = none[first].astype(np.uint8) + none[last]
        return dealt_out(pdf["block"].iloc[0], k1[first], 1 << 64, k1[first], k2[first], low, ids[last].view(np.uint64) - low, flag)

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block those of its windows that stand in a document earlier than one of its own, and the first such."""
        got = [unpacked(x, "<u8", "<u4", "<u8", "<u8", "u1") for x in pdf["data"]]
        k1, k2, low, more, flag = (np.concatenate(c) for c in zip(*got))
        high, low = (low + more).view(np.int64), low.view(np.int64)
        order = np.lexsort((low, flag == 2, k2, k1) if flag.any() else (low, k2, k1))
        new = starts(k1[order], k2[order])
        lead = np.empty(len(low), np.int64)
        lead[order] = order[new][np.cumsum(new) - 1]
        small = low[lead]
        on, out, end = (flag[lead] < 2) & ((flag > 0) | (small < high)), [], 0
        for block, g in zip(pdf["block"], got):
            own = end + np.flatnonzero(on[end : end + len(g[0])])
            end += len(g[0])
            if len(own):
                out.append((block, packed(k1[own], k2[own], small[own].view(np.uint64))))
        return pd.DataFrame(out, columns=["block", "data"])

    def remove(pdf: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=["id", "none", "n_words", "n_removed", "kept"])
        b = Block(pdf.iloc[0], width)
        total = int(b.ends[-1]) if len(b.ends) else 0
        cover = np.zeros(total + width + 1, np.int64)
        if len(answer):
            k1, k2, small = (np.concatenate(c) for c in zip(*(unpacked(x, "<u8", "<u4", "<u8") for x in answer["data"])))
            order = np.lexsort((k2, k1))
            k1, k2, small = k1[order], k2[order], small[order].view(np.int64)
            at, ids, none = np.searchsorted(k1, b.key1), b.ids[b.doc], b.none[b.doc]
            for step in range(int(np.unique(k1, return_counts=True)[1].max())):  # more than one only where 64 bits agree by chance
                i = np.minimum(at + step, len(k1) - 1)
                start = b.at[(k1[i] == b.key1) & (k2[i] == b.key2) & (none | (small[i] < ids))]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + width, -1)
        gone = np.cumsum(cover)[:total] > 0
        kept, removed, start = [], [], 0
        for words, end in zip(b.words, b.ends):
            g = gone[start:end]
            removed.append(int(g.sum()))
            kept.append(b" ".join(words if not removed[-1] else [w for w, x in zip(words, g.tolist()) if not x]))
            start = end
        return pd.DataFrame({"id": b.ids, "none": b.none, "n_words": [len(w) for w in b.words], "n_removed": removed, "kept": kept})

    by_shard, by_block = "block long, shard int, data binary", "block long, data binary"
    often = dealt.groupBy("block").applyInPandas(sketch, by_shard).groupBy("shard").applyInPandas(merge, by_shard)
    found = dealt.groupBy("block").cogroup(often.groupBy("block")).applyInPandas(candidates, by_shard).groupBy("shard").applyInPandas(least, by_block)
    left = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(remove, "id long, none boolean, n_words long, n_removed long, kept binary")
    return left.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)),
k AS (SELECT doc_id, i, md5(string_agg(x, ' ') OVER r) AS key, count(*) OVER r AS n FROM p WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT key, min(doc_id) AS first FROM k WHERE n = 13 GROUP BY key),
f AS (SELECT doc_id, i FROM k JOIN m USING (key) WHERE n = 13 AND first < doc_id),
c AS (SELECT p.doc_id, p.i, p.x, max(f.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS near FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (near IS NOT NULL AND i < near + 13) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (near IS NULL OR i >= near + 13), '') AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)
"""
