"""Runs: stretches of words that repeat with a period, found by minimizers on several scales.

A run is a maximal stretch with smallest period q that is at least twice as long as q. Periods below
``LAGS`` are found by comparing the words with themselves at each lag. Above, each scale takes the
periods from L to 2 L - 1. A run of such a period holds a window of L words whose copy stands q words
on, so the least hash among the window's parts of L / 2 words, its minimizer, stands q words on too:
pairs of equal minimizers at such distances seed the search, and a seed grows in both directions as far
as words q apart agree. Parts with a period of at most L / 4 lie in runs that are known by then. They
are left out, so equal parts are L / 4 words apart at least and a minimizer has few partners. A run whose
first period is nothing but such parts joins two known runs of one period that touch: their phases give
the periods that can join them.

The work on a batch of texts is a few passes of numpy for each scale; texts shorter than a scale's runs
aren't in it. Every text is searched whole, and no text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, table, texts_of, unwrapped, wrapped

#: Runs are at least so many words long.
LEAST = 12
#: Shorter periods are found by direct comparison; a power of two, and LAGS / 2 must be LEAST or more.
LAGS = 32
#: Words in a batch of texts; a longer text is a batch of its own.
BATCH = 300_000
NONE = np.uint64((1 << 64) - 1)


class Found:
    """Runs by (start, end), each with its smallest period. Periods come in ascending order within a stretch:
    one that is a multiple of another gives the same stretch and isn't taken."""

    def __init__(self, x: np.ndarray):
        self.x, self.of = x, {}

    def add(self, start: int, end: int, period: int) -> None:
        self.of[start, end] = min(period, self.of.get((start, end), period))

    def grow(self, at: int, lag: int) -> tuple[int, int]:
        """The longest stretch of places t around ``at`` with x[t] == x[t + lag]; empty if it isn't so there."""
        x = self.x
        if x[at] != x[at + lag]:
            return at, at
        low = high = at
        step = 64
        while low > 0:
            n = min(step, low)
            differ = np.flatnonzero(x[low - n : low] != x[low - n + lag : low + lag])
            if len(differ):
                low = low - n + int(differ[-1]) + 1
                break
            low, step = low - n, step * 2
        step = 64
        while high + lag < len(x):
            n = min(step, len(x) - high - lag)
            differ = np.flatnonzero(x[high : high + n] != x[high + lag : high + lag + n])
            if len(differ):
                high += int(differ[0])
                break
            high, step = high + n, step * 2
        return low, high

    def seeds(self, at: np.ndarray, lag: np.ndarray) -> None:
        """Grow each pair of places; those inside the last stretch of their lag are known."""
        order = np.lexsort((at, lag))
        last, end = -1, -1
        for p, q in zip(at[order].tolist(), lag[order].tolist()):
            if q == last and p < end:
                continue
            low, high = self.grow(p, q)
            last, end = q, high
            if high - low >= q:
                self.add(low, high + q, q)

    def table(self) -> np.ndarray:
        """(start, end, period), in order."""
        return np.array(sorted((s, e, q) for (s, e), q in self.of.items()), np.int64).reshape(-1, 3)


def scan(found: Found, lags: int, least: int) -> None:
    """Runs of all periods below ``lags``."""
    x = found.x
    for q in range(1, min(lags, len(x))):
        same = np.flatnonzero(x[q:] == x[:-q])
        if not len(same):
            continue
        first = np.flatnonzero(np.append(True, np.diff(same) > 1))
        last = np.append(first[1:], len(same)) - 1
        low, high = same[first], same[last] + 1
        for i in np.flatnonzero(high - low >= max(least - q, q)):
            found.add(int(low[i]), int(high[i]) + q, q)


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value of some window of ``width`` of them, the first of equal ones; NONE is no value."""
    bits = np.uint64(len(h).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    m = np.where(h == NONE, NONE, (h & ~low) | np.arange(len(h), dtype=np.uint64))
    size = 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    m = m[np.append(True, m[1:] != m[:-1])] if len(m) else m
    return np.unique((m[m != NONE] & low).astype(np.int64))


def touching(found: Found, lag: int, rows: np.ndarray) -> None:
    """Runs of periods from ``lag`` to twice that whose halves lie in two runs of a period of lag / 4 at most that touch."""
    rows = rows[(rows[:, 2] * 4 <= lag) & (rows[:, 1] - rows[:, 0] >= lag)]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    x = found.x
    for a, b in zip(rows[:-1], rows[1:]):
        d = int(a[2])
        if d != b[2] or b[0] > a[1]:
            continue
        s1, e1, s2, e2 = int(a[0]), int(a[1]), int(b[0]), int(b[1])
        lead = x[s2 : s2 + d]
        phase = next((o for o in range(d) if x[s1 + o] == lead[0] and (x[s1 + o : s1 + o + d] == lead).all()), None)
        if phase is None:
            continue
        q = lag + (s2 - s1 - phase - lag) % d
        while q < min(2 * lag, e1 - s1 + 1, e2 - s2 + 1):
            at = max(s1, s2 - q)
            if at < e1 and at + q < e2:
                low, high = found.grow(at, q)
                if high - low >= q:
                    found.add(low, high + q, q)
            q += d


def runs_in(x: np.ndarray, sizes: np.ndarray, least: int = LEAST, lags: int = LAGS) -> np.ndarray:
    """(start, end, period) of the runs in x: word numbers of several texts, after each of them one that occurs once.

    sizes: the lengths of the texts, those words counted.
    """
    found = Found(x)
    scan(found, lags, least)
    # hashes of parts of 1, 2, 4 ... words; place: where the words of the texts that are still long enough stand
    h, place, k, lag = mixed(x.astype(np.uint64)), np.arange(len(x)), 1, lags
    while (sizes > 2 * lag).any():
        stay = sizes > 2 * lag
        if not stay.all():
            on = np.repeat(stay, sizes)
            h, place, sizes = h[on], place[on], sizes[stay]
        while k < lag // 2:
            h = np.append(mixed(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]), np.full(k, NONE))
            k *= 2
        known = found.table()
        some, short = h, known[(known[:, 2] * 2 <= k) & (known[:, 1] - known[:, 0] >= k)]
        if len(short):
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, short[:, 0], 1)
            np.add.at(edge, short[:, 1] - k + 1, -1)
            some = np.where((np.cumsum(edge)[:-1] > 0)[place], NONE, h)
        at = minimizers(some, k + 1)
        order = np.argsort(h[at], kind="stable")
        at = at[order]
        value, seeds, step = h[at], [], 1
        while step < len(at):
            same = np.flatnonzero(value[step:] == value[:-step])
            if not len(same):
                break
            far = place[at[same + step]] - place[at[same]]
            near = (far >= lag) & (far < 2 * lag)
            seeds.append((place[at[same[near]]], far[near]))
            if (far >= 2 * lag).all():
                break
            step += 1
        if seeds:
            found.seeds(*(np.concatenate(s) for s in zip(*seeds)))
        touching(found, lag, known)
        lag *= 2
    return found.table()


def batches_of(words: Iterator[tuple[int, list[bytes]]], size: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    held: list[tuple[int, list[bytes]]] = []
    n = 0
    for i, w in words:
        if held and n + len(w) > size:
            yield held
            held, n = [], 0
        held.append((i, w))
        n += len(w) + 1
    if held:
        yield held


def described(words: list[bytes], rows: np.ndarray) -> tuple:
    """The columns of a text from its runs (start, end, period)."""
    out = [len(rows), None, None, None, None]
    listed = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    if len(rows):
        size = rows[:, 1] - rows[:, 0]
        s, e, q = rows[np.lexsort((rows[:, 2], rows[:, 0], -size))[0]].tolist()
        out[1:] = [s, e - s, q, 1000 * (e - s) // q]
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
        np.add.at(gone, rows[:, 1], -1)
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    kept = b" ".join(words)
    text = b"".join(b"%d,%d,%d\n" % (s, e - s, q) for s, e, q in listed.tolist())
    return *out, [(s, e - s, q) for s, e, q in listed.tolist()], hashlib.sha256(text).hexdigest(), kept


LISTED = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
FIELDS = [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [("runs", pa.list_(LISTED)), ("runs_sha256", pa.string()), ("collapsed", pa.binary())]
KIND = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, runs_sha256 string, collapsed binary"


def described_texts(batch: pa.RecordBatch, least: int = LEAST, lags: int = LAGS, size: int = BATCH) -> pa.StructArray:
    """A struct of KIND for each of the texts in column ``text``."""
    out: list[tuple] = [()] * batch.num_rows
    for held in batches_of(((i, t.split()) for i, t in enumerate(texts_of(batch))), size):
        numbers: dict[bytes, int] = {}
        ids, sizes = [], np.array([len(w) + 1 for _, w in held], np.int64)
        for k, (_, words) in enumerate(held):
            ids.extend(numbers.setdefault(w, len(numbers)) for w in words)
            ids.append(-1 - k)
        rows, ends = runs_in(np.array(ids, np.int64), sizes, least, lags), np.cumsum(sizes)
        of = np.searchsorted(ends, rows[:, 0], "right")
        cut = np.searchsorted(of, np.arange(len(held) + 1))
        for k, (i, words) in enumerate(held):
            own = rows[cut[k] : cut[k + 1]] - [ends[k] - sizes[k], ends[k] - sizes[k], 0]
            out[i] = described(words, own)
    columns = list(zip(*out)) or [()] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], [n for n, _ in FIELDS])


def periodic_runs(docs: DataFrame, least: int = LEAST, lags: int = LAGS) -> DataFrame:
    """docs with n_runs; start, length, period and exponent_milli of the longest run; ``runs``, ``runs_sha256`` and ``collapsed``.

    Words are what ASCII white space parts. A run is a stretch of max(``least``, 2 q) words or more with
    smallest period q that no neighbouring word extends. The longest is the one with the smallest start,
    then period, among equals; without a run its four columns are null. runs lists (start, length, period)
    by start, then period, and its digest is that of ``start,length,period`` lines. collapsed is the text
    without the words that lie in a run after its first period, joined by single spaces; no run spans texts.

    Null and empty texts have no words and an empty collapsed text; very long texts are searched whole, and a
    text has to fit a task's memory some thirty times; repeated rows are judged each by itself; other columns
    stay, and those of the names above are replaced; an empty table gives an empty one.
    """
    if lags & (lags - 1) or lags // 2 < least:
        raise ValueError("lags has to be a power of two and at least twice the least length of a run")

    @F.arrow_udf(KIND)
    def runs(text: pa.Array) -> pa.Array:
        return described_texts(pa.RecordBatch.from_arrays([text], ["text"]), least, lags)

    out = wrapped(docs).withColumn("_runs", runs(F.col("_in.text").cast("binary")))
    added: dict[str, Column] = {n: F.col(f"_runs.{n}") for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256")}
    return unwrapped(out, docs, **added, collapsed=F.col("_runs.collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """docs whose texts repeat from a word on where the contract of the query plants it, by the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    out = docs.select("*", F.floor(h / 10).alias("_g"), words.alias("_w")).withColumn("_n", F.size("_w"))
    out = out.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    text = F.expr("array_join(transform(sequence(0, _n - 1), i -> _w[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')")
    return out.select(*docs.columns[: docs.columns.index("text")], F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"), *docs.columns[docs.columns.index("text") + 1 :])


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))
