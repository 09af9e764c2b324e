"""Best-fit packing of documents into training sequences by linear grouping.

Pieces are at most ``capacity`` tokens long, so however many there are, their lengths make a table
of at most ``capacity`` counts. The plan is made on that table alone: large lengths are put into
groups of equal cardinality and rounded up to their group's longest, the few rounded sizes are
packed by whole configurations, actual pieces take the rounded places (they are no longer, so each
fits), and small pieces then go by best fit into what is left. The plan is a table of runs
(length, first rank, bins ...); pieces find their places in it by their rank among their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_per, settled, table, unwrapped, wrapped

CAPACITY, END_ID = 1024, 2
ENCODING = "byte_bpe_50k"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level BPE with the ranks in a .tiktoken file and <|endoftext|> after them.

    It gives the ids that the tokenizers library gives from byte_bpe_50k.json, three times as fast.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{ENCODING}.tiktoken")


def ids_of(text: str, vocabulary: str, end_id: int = END_ID) -> np.ndarray:
    bpe = encoder(vocabulary)
    ids = bpe.encode(text, allowed_special="all") if "<|endoftext|>" in text else bpe.encode_ordinary(text)
    return np.array([*ids, end_id], "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((i, capacity) for i in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece, and the columns in keep.

    A null text counts as empty, and an empty one is the end id alone. Very long texts make many pieces.
    Repeated rows are cut alike, each into pieces of its own; a null doc_id stays null; an empty table gives
    an empty one. Columns of docs that aren't in keep are left out and may have any names. Kept columns
    stay as they are, whatever their types: they never leave Arrow.
    """
    vocabulary = vocabulary or vocabulary_path()
    kind = docs.select("doc_id", *keep).schema
    own = [*kind.names, "piece", "start", "length", "ids"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [ids_of(t or "", vocabulary) for t in part.column(0).to_pylist()]
                cuts = [cut(len(x), capacity) for x in ids]
                rows = zip(*((k, s, n, x[s : s + n].tobytes()) for x, c in zip(ids, cuts) for k, (s, n) in enumerate(c)))
                of = pa.array(np.repeat(np.arange(len(cuts)), [len(c) for c in cuts]))
                kept = [c.take(of) for c in part.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(rows, types))], own)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kind)}, piece int, start long, length long, ids binary"
    return docs.select("text", "doc_id", *keep).mapInArrow(run, schema)


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Fill bins with few sizes: (how many of each size, how many bins), by column generation.

    The linear relaxation starts from bins of one size; as long as a knapsack over the dual values
    finds a better filling, it enters the basis. Bins are rounded down, so some items stay over.
    """
    k = len(sizes)
    fill = capacity // sizes
    basis, cost = np.diag(fill).astype(float), np.ones(k)
    inverse = np.diag(1 / fill)
    x = counts / fill
    for step in range(rounds):
        worth = cost @ inverse
        best, taken = np.zeros(capacity + 1), []
        for i in range(k):
            for _ in range(int(fill[i])):
                more = np.full(capacity + 1, -1.0)
                more[sizes[i] :] = best[: -sizes[i]] + worth[i]
                take = more > best + 1e-12
                best = np.where(take, more, best)
                taken.append((i, take))
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for i, take in reversed(taken):
            if take[room]:
                column[i] += 1
                room -= sizes[i]
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        if step % 40 == 39:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ counts, 0)
        else:
            row = inverse[out] / way[out]
            inverse = inverse - np.outer(way, row)
            inverse[out] = row
    return [(basis[:, j].astype(int), int(x[j] + 1e-6)) for j in range(k) if int(x[j] + 1e-6)]


class Bins:
    """Bins under way, by what room they have: {room: [(first bin, count)]}; runs are the plan's rows."""

    def __init__(self, capacity: int):
        self.capacity, self.new, self.by_room, self.runs = capacity, 0, {}, []

    def put(self, room: int, first: int, count: int, length: int, rank: int) -> None:
        """One piece of this length, from this rank on, into each of these bins."""
        self.runs.append((length, rank, count, first, self.capacity - room))
        self.leave(room - length, first, count)

    def leave(self, room: int, first: int, count: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append((first, count))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Each piece into the bin that it fills most; new bins where none has room."""
        while count and (room := min((r for r in self.by_room if r >= length), default=0)):
            runs = self.by_room[room]
            while count and runs:
                first, n = runs.pop()
                use = min(n, count)
                if use < n:
                    runs.append((first + use, n - use))
                self.put(room, first, use, length, rank)
                rank, count = rank + use, count - use
            if not runs:
                del self.by_room[room]
        each = self.capacity // length
        while count:
            full = max(1, count // each)
            per = min(each, count)
            first, self.new = self.new, self.new + full
            for i in range(per):
                self.runs.append((length, rank + i * full, full, first, i * length))
            self.leave(self.capacity - per * length, first, full)
            rank, count = rank + per * full, count - per * full


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 48) -> np.ndarray:
    """The plan with the fewest bins among those that call pieces over a half, a third or a fifth of the capacity large."""
    plans = [plan_at(counts, capacity, groups, share) for share in (0.5, 0.34, 0.2)]
    return min(plans, key=lambda r: (r[:, 3] + r[:, 2]).max(initial=0))


def plan_at(counts: np.ndarray, capacity: int, groups: int, large: float) -> np.ndarray:
    """Rows (length, first rank, pieces, first bin, offset): the pieces of a length from a rank on
    go one each into bins in a row, at an offset. counts[n]: how many pieces have length n.

    The rows depend on the table of counts, so there are at most about capacity squared of them.
    """
    bins, done = Bins(capacity), np.zeros(capacity + 1, np.int64)
    if counts[capacity]:
        bins.put(capacity, 0, int(counts[capacity]), capacity, 0)
        bins.new = int(counts[capacity])
    done[capacity] = counts[capacity]
    lengths = np.array([n for n in range(capacity - 1, int(large * capacity), -1) if counts[n]], np.int64)
    if len(lengths):
        # groups of equal cardinality, the longest first; a length stays whole, so a common one is a group of its own
        upto = np.cumsum(counts[lengths])
        group = np.minimum((upto - counts[lengths]) * groups // upto[-1], groups - 1)
        group = np.unique(group, return_inverse=True)[1]
        of = [lengths[group == g] for g in range(group[-1] + 1)]
        sizes, many = np.array([x[0] for x in of]), np.array([counts[x].sum() for x in of])
        queues = [[(int(n), int(counts[n])) for n in x] for x in of]
        for config, n in configurations(sizes, many, capacity):
            slots = [g for g in range(len(of)) for _ in range(config[g])]
            while n:
                # as many bins in a row as have pieces of the same lengths in all their slots
                step = max(1, min(n, *(queues[g][0][1] // config[g] for g in set(slots))))
                first, bins.new, n = bins.new, bins.new + step, n - step
                room = capacity
                for g in slots:
                    length, left = queues[g][0]
                    bins.runs.append((length, int(done[length]), step, first, capacity - room))
                    done[length] += step
                    room -= length
                    queues[g][0] = (length, left - step)
                    if left == step:
                        queues[g].pop(0)
                bins.leave(room, first, step)
    for length in range(capacity, 0, -1):
        if (rest := int(counts[length] - done[length])) > 0:
            bins.best_fit(length, int(done[length]), rest)
    return np.array(bins.runs, np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = 48) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to items (doc_id, piece, length, ...) in as few sequences as the plan needs.

    Lengths are 1 to ``capacity``. Only the counts by length come to the driver and only the plan,
    bounded by ``capacity``, goes out; ranks among pieces of a length are taken within blocks, so a
    common length isn't gathered in one task. Repeated rows are pieces of their own, and rows without a
    doc_id too; ties among equal lengths go by block, doc_id (null first) and piece, and which of repeated
    rows comes first doesn't matter, as they are alike; an empty table gives an empty one. Columns named
    sequence_id or offset are replaced, others stay whatever their names. items are read more than once:
    pass a table, or what ``settled`` returns.
    """
    spark = items.sparkSession
    found = items.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[found["length"]] = found["n"]
    rows = plan(counts, capacity, groups)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    sent = spark.sparkContext.broadcast(rows)
    blocks = rows_per(int(counts.sum()), 4000)
    keyed = wrapped(items).withColumns({"length": F.col("_in.length"), "_id": F.col("_in.doc_id"), "_piece": F.col("_in.piece")})
    keyed = keyed.withColumn("_block", F.expr(f"cast(pmod(xxhash64(_id, _piece), {blocks}) as int)"))
    starts = keyed.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    starts = starts.select("length", "_block", (F.sum("_n").over(Window.partitionBy("length").orderBy("_block")) - F.col("_n")).alias("_start"))
    within = keyed.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_block").orderBy("_id", "_piece")))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = sent.value
        # runs are in order of length and first rank
        at = np.searchsorted(r[:, 0] * (1 << 40) + r[:, 1], length.to_numpy() * (1 << 40) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": r[at, 3] + rank.to_numpy() - r[at, 1], "offset": r[at, 4]})

    out = within.join(starts, ["length", "_block"]).withColumn("_at", placed("length", F.col("_start") + F.col("_row") - 1))
    return unwrapped(out, items, sequence_id="_at.sequence_id", offset="_at.offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = pieces(table(spark, sf_dir, "documents"))
    digest = settled(cuts.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(digest)
