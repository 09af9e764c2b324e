"""Collocations: phrases of up to three words, counted exactly in HAT-tries and scored by their weakest cut.

Each task numbers the words it meets and counts phrases in a trie: under a shallow root, whose branches
are the prefix partitions, lie containers of keys (the word numbers of a phrase). New keys go into a
container as they come; a container that has grown folds equal ones into counts, and one with too many
different keys bursts into branches by the phrase's next word. When the trie as a whole is too large, its
largest subtrees are spilled: each leaves the task as one sorted run. Runs meet by prefix partition, where
they are merged and their counts added. A partition is chosen by the first two words, and by some bits of
the third, so that neither a frequent word nor a frequent pair is one task's work.

What travels between tasks are 64-bit hashes of (lang, word), in the run's own dictionary; the words
themselves are counted the same way, once each, which also shows whether two of them share a hash. In
that case all is counted again with other hashes, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import distinct, mixed, settled, table, texts_of
from .substrings import packed, starts, unpacked

LEAST, TOP, INSIDE = 10, 2000, 50
#: Word numbers have 21 bits, three of them make a key; a task starts a new trie before they run out.
BITS = 21


class Room(NamedTuple):
    """What a task holds at most: different keys in a trie before it spills, keys added since they were last folded, keys in a
    container before it bursts or folds, words before a new trie begins, and words that are added at once."""

    held: int = 3_000_000
    loose: int = 1_000_000
    burst: int = 250_000
    fold: int = 4096
    words: int = 500_000
    chunk: int = 200_000


#: Bytes of text a prefix partition, and over how many partitions the third words of a pair are dealt.
SHARE, SLICES = 6 << 20, 16
STOP = b"."
STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", STOP * 9)


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words, and STOP between pieces; no word can hold one."""
    return text.lower().translate(STOPS).replace(STOP, b" . ").split()


class Words(dict):
    """Numbers of the words of a language from 1 on, across languages; 0 is a stop. hashes[number] is a word's hash."""

    def __init__(self, lang: str, hashes: list[int], seed: int):
        super().__init__({STOP: 0})
        self.head, self.hashes, self.seed = lang.encode() + b"\0", hashes, seed

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(self.head + word, self.seed))
        return n


def folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(starts(keys))
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


class Container:
    """Counts of keys; ``depth`` words of them led here. After a burst it is a branch with a container for each of 16 kinds of the next word."""

    def __init__(self, depth: int, room: Room):
        self.depth, self.room, self.keys, self.counts = depth, room, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.loose: list[np.ndarray] = []
        self.n_loose, self.below = 0, None

    def add(self, keys: np.ndarray) -> None:
        if self.below:
            kind = (keys >> (BITS * (2 - self.depth))) & 15
            order = np.argsort(kind, kind="stable")
            cut = np.searchsorted(kind[order], np.arange(17))
            for i in np.flatnonzero(np.diff(cut)):
                self.below[i].add(keys[order[cut[i] : cut[i + 1]]])
            return
        self.loose.append(keys)
        self.n_loose += len(keys)
        if self.n_loose > max(self.room.fold, len(self.keys)):
            self.fold()

    def fold(self) -> None:
        if self.below:
            for c in self.below:
                c.fold()
        elif self.loose:
            new = np.sort(np.concatenate(self.loose))
            at = np.flatnonzero(starts(new))
            new, n = new[at], np.diff(np.append(at, len(new)))
            self.keys, self.counts = folded(np.concatenate([self.keys, new]), np.concatenate([self.counts, n])) if len(self.keys) else (new, n)
            self.loose, self.n_loose = [], 0
            if len(self.keys) > self.room.burst and self.depth < 2:
                kind = (self.keys >> (BITS * (2 - self.depth))) & 15
                self.below = [Container(self.depth + 1, self.room) for _ in range(16)]
                for i, c in enumerate(self.below):
                    c.keys, c.counts = self.keys[kind == i], self.counts[kind == i]
                self.keys, self.counts = self.keys[:0], self.counts[:0]

    def size(self) -> int:
        return sum(c.size() for c in self.below) if self.below else len(self.keys) + self.n_loose

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        if not self.below:
            return self.keys, self.counts
        keys, counts = zip(*(c.rows() for c in self.below))
        return np.concatenate(keys), np.concatenate(counts)


class HatTrie:
    """Phrases of two and three words by prefix partition, of all languages of a task."""

    def __init__(self, parts: int, seed: int, room: Room = Room()):
        self.parts, self.seed, self.room = parts, seed, room
        self.hashes: list[int] = [0]
        self.langs: dict[str, Words] = {}
        self.below: dict[int, Container] = {}
        self.single, self.size = np.zeros(1, np.int64), 0

    def full(self) -> bool:
        return len(self.hashes) > self.room.words

    def add(self, lang: str, words: list[bytes]) -> None:
        """words: of texts of one language, with stops between pieces and texts."""
        names = self.langs.get(lang)
        if names is None:
            names = self.langs[lang] = Words(lang, self.hashes, self.seed)
        a = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        n = np.bincount(a, minlength=len(self.hashes))
        n[: len(self.single)] += self.single
        n[0] = 0
        self.single = n
        pair = (a[:-1] != 0) & (a[1:] != 0)
        key = (a[:-1] << (2 * BITS)) | (a[1:] << BITS)
        three = np.flatnonzero(pair[:-1] & pair[1:])
        keys = np.concatenate([key[pair], key[three] | a[three + 2]])
        if not len(keys):
            return
        h = np.array(self.hashes, np.uint64)
        part = self.part(h, keys)
        order = np.argsort(part, kind="stable")
        keys, part = keys[order], part[order]
        at = np.flatnonzero(starts(part))
        for p, own in zip(part[at].tolist(), np.split(keys, at[1:])):
            self.below.setdefault(p, Container(0, self.room)).add(own)
        self.size += len(keys)

    def part(self, h: np.ndarray, keys: np.ndarray) -> np.ndarray:
        one, two, three = (h[(keys >> (BITS * i)) & ((1 << BITS) - 1)] for i in (2, 1, 0))
        return ((mixed(one + mixed(two)) % np.uint64(self.parts) + three % np.uint64(SLICES)) % np.uint64(self.parts)).astype(np.int64)

    def spilled(self, all_of_it: bool = False) -> Iterator[tuple]:
        """Once too much is held, the largest subtrees until half of the room is free again: (part, null, null, run)."""
        if not all_of_it and self.size <= self.room.held + self.room.loose:
            return
        sizes: dict[int, int] = {}
        for p, c in self.below.items():
            c.fold()
            sizes[p] = c.size()
        self.size = sum(sizes.values())
        if not all_of_it and self.size <= self.room.held:
            return
        h = np.array(self.hashes, np.uint64)
        for p in sorted(sizes, key=sizes.get, reverse=True):
            if not all_of_it and self.size <= self.room.held // 2:
                break
            self.size -= sizes[p]
            yield p, None, None, run_of(*self.below.pop(p).rows(), h)

    def words(self) -> Iterator[tuple]:
        """The words of each language with their counts, by partition: (-1 - part, lang, words, run)."""
        h = np.array(self.hashes, np.uint64)
        single = np.append(self.single, np.zeros(len(h) - len(self.single), np.int64))
        for lang, names in self.langs.items():
            text, at = np.array(list(names), object), np.fromiter(names.values(), np.int64, len(names))
            text, at = text[at > 0], at[at > 0]
            part = (mixed(h[at]) % np.uint64(self.parts)).astype(np.int64)
            order = np.lexsort((h[at], part))
            text, at, part = text[order], at[order], part[order]
            first = np.flatnonzero(starts(part))
            for p, w, i in zip(part[first].tolist(), np.split(text, first[1:]), np.split(at, first[1:])):
                if len(i):
                    yield -1 - p, lang, zstandard.compress(b" ".join(w), 1), packed(h[i], single[i].astype(np.uint64))


def run_of(keys: np.ndarray, counts: np.ndarray, h: np.ndarray) -> bytes:
    """A sorted run: its words' hashes in order, and phrases by the places of their words among them, counts beside."""
    mask = (1 << BITS) - 1
    ids = [(keys >> (BITS * i)) & mask for i in (2, 1, 0)]
    used = distinct(np.concatenate(ids))
    used = used[used > 0]
    used = used[np.argsort(h[used])]
    place = np.zeros(len(h), np.int64)
    place[used] = np.arange(1, len(used) + 1)
    key = (place[ids[0]] << (2 * BITS)) | (place[ids[1]] << BITS) | place[ids[2]]
    order = np.argsort(key)
    few = counts.max(initial=0) < 1 << 16
    names, body = packed(h[used]), packed(key[order].astype(np.uint64), counts[order].astype(np.uint16 if few else np.uint64))
    return bytes([int(few)]) + len(names).to_bytes(8, "little") + names + body


def run_read(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, keys, counts) of a run."""
    size = int.from_bytes(run[1:9], "little")
    key, n = unpacked(run[9 + size :], "<u8", "<u2" if run[0] else "<u8")
    return unpacked(run[9 : 9 + size], "<u8")[0], key.astype(np.int64), n.astype(np.int64)


RUN = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("run", pa.binary())])
COUNTED = "lang string, word binary, h1 long, h2 long, h3 long, f long"


def counted(docs: DataFrame, parts: int, seed: int, least: int, room: Room = Room()) -> DataFrame:
    """Words (lang, word, h1, f) and phrases (h1, h2, h3, f) that occur ``least`` times or more, of each lang the number of all its
    words (lang, f) in parts, and a row without lang and f where two words share a hash (h1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(parts, seed, room)

        def sent(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for r in rows:
                held.append(r)
                size += len(r[3]) + len(r[2] or b"")
                if size > most:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RUN.types)], RUN.names)

        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                held = texts.setdefault(lang, [])
                held += tokens(text)
                held.append(STOP)
                if len(held) > room.chunk:
                    trie.add(lang, texts.pop(lang))
                    yield from sent(trie.spilled())
                    if trie.full():
                        yield from sent(trie.spilled(True))
                        yield from sent(trie.words())
                        trie = HatTrie(parts, seed, room)
            for lang, held in texts.items():
                trie.add(lang, held)
            yield from sent(trie.spilled())
        yield from sent(trie.spilled(True))
        yield from sent(trie.words())

    def merge(runs: pa.Table) -> pa.Table:
        return merged_words(runs, least) if runs["part"][0].as_py() < 0 else merged_runs(runs, least)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    runs = rows.mapInArrow(count, "part long, lang string, words binary, run binary")
    return runs.groupBy("part").applyInArrow(merge, COUNTED)


def counted_table(lang=None, word=None, h1=None, h2=None, h3=None, f=None) -> pa.Table:
    """A table with the columns of COUNTED, those not given null."""
    n = len(f)
    columns = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip((lang, word, h1, h2, h3, f), [pa.string(), pa.binary(), *[pa.int64()] * 4])]
    return pa.Table.from_arrays(columns, ["lang", "word", "h1", "h2", "h3", "f"])


def merged_words(runs: pa.Table, least: int) -> pa.Table:
    total: dict[tuple[str, bytes], list[int]] = {}
    for lang, words, run in zip(*(runs[c].to_pylist() for c in ("lang", "words", "run"))):
        h, n = unpacked(run, "<u8", "<u8")
        for w, k, m in zip(zstandard.decompress(words).split(b" "), h.view(np.int64).tolist(), n.tolist()):
            x = total.setdefault((lang, w), [k, 0])
            x[1] += m
    seen: dict[int, int] = {}
    sums: dict[str, int] = {}
    for (lang, _), (k, n) in total.items():
        seen[k] = seen.get(k, 0) + 1
        sums[lang] = sums.get(lang, 0) + n
    often = [(lang, w, k, n) for (lang, w), (k, n) in total.items() if n >= least]
    shared = [k for k, n in seen.items() if n > 1]
    tables = [counted_table(lang=list(sums), f=list(sums.values())), counted_table(h1=shared, f=[None] * len(shared))]
    if often:
        lang, word, h1, f = zip(*often)
        tables.append(counted_table(lang=lang, word=word, h1=h1, f=f))
    return pa.concat_tables(tables)


def merged_runs(runs: pa.Table, least: int) -> pa.Table:
    read = [run_read(x) for x in runs["run"].to_pylist()]
    names = distinct(np.concatenate([r[0] for r in read]))
    mask, wide = (1 << BITS) - 1, len(names) >= 1 << BITS
    keys, ends = [], []
    for h, key, _ in read:
        place = np.append(0, np.searchsorted(names, h) + 1)
        one, two, three = (place[(key >> (BITS * i)) & mask] for i in (2, 1, 0))
        keys.append((one << (2 * BITS)) | (two << BITS) | three if not wide else (one << 32) | two)
        ends.append(three)
    key, three, n = np.concatenate(keys), np.concatenate(ends), np.concatenate([r[2] for r in read])
    if wide:  # more words than the bits of a key can number
        order = np.lexsort((three, key))
        key, three, n = key[order], three[order], n[order]
        at = np.flatnonzero(starts(key, three))
        n = np.add.reduceat(n, at)
        one, two, three = key[at] >> 32, key[at] & ((1 << 32) - 1), three[at]
    else:
        key, n = folded(key, n)
        one, two, three = ((key >> (BITS * i)) & mask for i in (2, 1, 0))
    on = n >= least
    hashes = np.append(np.uint64(0), names).view(np.int64)
    return counted_table(h1=hashes[one[on]], h2=hashes[two[on]], h3=pa.array(hashes[three[on]], mask=three[on] == 0), f=n[on])


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits: exact for counts below 10 ** 15."""
    d = "cast({} as decimal(16, 0))".format
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({d(a)} * {d(a)})) div ({d(left)} * {d(right)})")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, share: int = SHARE, room: Room = Room()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top`` phrases of two or three words.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into
    words; phrases lie within pieces, and all their occurrences count, overlaps included. A phrase that occurs a
    times, ``least`` at least, is scored at its weakest cut into parts that occur l and r times:
    floor(1000000 a a / (l r)), of equal ones the first. A phrase is left out if a longer candidate that holds its
    words has ``inside`` % of its occurrences or more. Ranks go by score and a, both descending, then by phrase
    in byte order; n is the number of the language's words.

    A null lang is ``und``, as is that name itself; null and empty texts have no words; very long texts count whole;
    repeated rows count each; doc_id and all other columns are left out and may have any names; an empty table
    gives an empty one. Words are taken as bytes, whatever they hold.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, size // share)
    for seed in range(8):
        found = settled(counted(docs, parts, seed, least, room), "phrases")
        if found.where("lang is null and f is null").isEmpty():
            break
    else:
        raise RuntimeError("words share hashes under each of eight seeds")
    totals = found.where("lang is not null and word is null").groupBy("lang").agg(F.sum("f").alias("n"))
    words = found.where("word is not null").select(F.col("h1").alias("h"), "lang", F.col("word").cast("string").alias("w"), "f")

    def word(i: int) -> DataFrame:
        return words.select(F.col("h").alias(f"h{i}"), F.col("w").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))

    two = found.where("h2 is not null and h3 is null").select("h1", "h2", F.col("f").alias("a"))
    three = found.where("h3 is not null").select("h1", "h2", "h3", F.col("f").alias("a"))
    pairs = settled(two.join(word(1), "h1").join(word(2), "h2").select("lang", "h1", "h2", "a", F.concat_ws(" ", "w1", "w2").alias("phrase"), "f1", "f2"), "pairs")
    triples = three.join(pairs.select("lang", "h1", "h2", F.col("phrase").alias("lead"), "f1", F.col("a").alias("f12")), ["h1", "h2"])
    triples = triples.join(pairs.select("h1", "h2", F.col("a").alias("f23")).toDF("h2", "h3", "f23"), ["h2", "h3"]).join(word(3), "h3")
    triples = settled(triples.select("lang", "h1", "h2", "h3", "a", F.concat_ws(" ", "lead", "w3").alias("phrase"), "f1", "f23", "f12", "f3"), "triples")
    held = triples.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "a")
    held = held.groupBy("p.h1", "p.h2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(held, ["h1", "h2"], "left").where(f"longer is null or 100 * longer < {inside} * a")

    cut = F.struct("score", "l", "r")
    first = F.struct(score("a", "f1", "f23").alias("score"), F.col("f1").alias("l"), F.col("f23").alias("r"))
    last = F.struct(score("a", "f12", "f3").alias("score"), F.col("f12").alias("l"), F.col("f3").alias("r"))
    scored = pairs.withColumns({"score": score("a", "f1", "f2"), "l": F.col("f1"), "r": F.col("f2")}).select("lang", "phrase", "a", cut.alias("cut"))
    scored = scored.union(triples.select("lang", "phrase", "a", F.when(first["score"] <= last["score"], first).otherwise(last).alias("cut")))
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    scored = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(f"rank <= {top}")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {top}")
    out = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.*", "n")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
u AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM u GROUP BY lang),
b AS (SELECT lang, p[1] AS x, p[2] AS y, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM w) GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, p[1] AS x, p[2] AS y, p[3] AS z, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS p FROM w) GROUP BY ALL HAVING count(*) >= 10),
s2 AS (SELECT b.lang, b.x || ' ' || b.y AS phrase, b.a, l.f AS l, r.f AS r FROM b JOIN u l ON l.lang = b.lang AND l.x = b.x JOIN u r ON r.lang = b.lang AND r.x = b.y
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lang = b.lang AND ((t.x = b.x AND t.y = b.y) OR (t.y = b.x AND t.z = b.y)) AND 100 * t.a >= 50 * b.a)),
c3 AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.a, l1.f AS l1, r1.a AS r1, l2.a AS l2, r2.f AS r2, (1000000::HUGEINT * t.a * t.a) // (l1.f::HUGEINT * r1.a) AS s1, (1000000::HUGEINT * t.a * t.a) // (l2.a::HUGEINT * r2.f) AS s2
  FROM t JOIN u l1 ON l1.lang = t.lang AND l1.x = t.x JOIN b r1 ON r1.lang = t.lang AND r1.x = t.y AND r1.y = t.z JOIN b l2 ON l2.lang = t.lang AND l2.x = t.x AND l2.y = t.y JOIN u r2 ON r2.lang = t.lang AND r2.x = t.z),
s AS (SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM s2
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""
