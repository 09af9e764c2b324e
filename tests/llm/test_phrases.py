"""Phrase counts, cuts and ranks against brute force; tries that spill, burst and start anew."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provender.llm import phrases


def expected(rows, least=10, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in some.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in some.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.append((lang, -s, -a, b" ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranked, rank = [], Counter()
    for lang, s, a, p, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], p.decode(), -a, left, right, total, -s))
    return ranked


ROWS = [
    ("en", "The quick fox. the quick fox, THE QUICK FOX jumps; the quick\tfox! " * 6), ("en", "a a a a a a a a a a a a a a a\nb a b a b a"), (None, "null lang words here " * 12), ("und", "null lang words here " * 5),
    ("de", "Ünder ünder über ünder über. " * 15), ("de", None), ("en", ""), ("en", " \t "), ("fr", "once only words"), ("x y", "\x00 odd \x1c bytes \x00 odd " * 11), ("en", "tie one tie two " * 10), ("en", "tie one tie two " * 10), ("", "empty lang name " * 10),
]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("room", [phrases.Room(), phrases.Room(held=60, loose=20, burst=8, fold=8, chunk=50), phrases.Room(held=500, burst=4, fold=4, words=12, chunk=30)], ids=["whole", "spilling", "new tries"])
def test_against_brute_force(spark, room):
    rng = np.random.default_rng(1)
    rows = [*ROWS, *(("en", " ".join(rng.choice(["p", "q", "r", "s.", "t"], 200))) for _ in range(20))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(expected(rows))
    assert rows_of(phrases.collocations(docs.coalesce(1), room=room)) == want
    extra = docs.withColumns({c: F.lit(1) for c in ("doc_id", "phrase", "rank", "n", "part", "run", "words", "word", "h1")})
    assert rows_of(phrases.collocations(extra.repartition(3), share=100, room=room)) == want
    assert [r[:4] for r in rows_of(phrases.collocations(docs, top=3))] == [r[:4] for r in sorted(expected(rows, top=3))]


def test_runs_of_a_trie():
    """Bursting, folding and spilling keep every count; a run gives back what was put in; keys are in order of hashes."""
    trie = phrases.HatTrie(4, 0, phrases.Room(burst=16, fold=8))
    rng = np.random.default_rng(2)
    words = [b"w%d" % i for i in rng.integers(0, 30, 5000)]
    for i in range(0, 5000, 100):
        trie.add("en", words[i : i + 100] + [phrases.STOP])
    assert any(c.below for c in trie.below.values())
    name = {h: w for w, h in ((w, trie.hashes[i]) for w, i in trie.langs["en"].items())}
    got = Counter()
    for part, _, _, run in trie.spilled(True):
        h, key, n = phrases.run_read(run)
        assert (np.diff(h.astype(object)) > 0).all() and (np.diff(key) > 0).all()
        at = np.append(np.uint64(0), h)
        for k, m in zip(key.tolist(), n.tolist()):
            ids = [k >> 42, (k >> 21) & ((1 << 21) - 1), k & ((1 << 21) - 1)]
            got[tuple(name[int(at[i])] for i in ids if i)] += m
    want = Counter()
    for i in range(0, 5000, 100):
        w = words[i : i + 100]
        want += Counter(zip(w, w[1:])) + Counter(zip(w, w[1:], w[2:]))
    assert got == want and trie.size == 0


def test_words_that_share_a_hash(spark, monkeypatch):
    """Words whose hashes agree are told from one another, and counted again under another seed."""
    rows = phrases.merged_words(pa.table({"lang": ["en", "en"], "words": [phrases.zstandard.compress(b"a"), phrases.zstandard.compress(b"b")], "run": [phrases.packed(np.array([7], np.uint64), np.array([12], np.uint64))] * 2}), 10).to_pylist()
    assert {(r["lang"], r["word"], r["h1"], r["f"]) for r in rows} == {("en", None, None, 24), (None, None, 7, None), ("en", b"a", 7, 12), ("en", b"b", 7, 12)}
    seeds, real = [], phrases.counted

    def counted(docs, parts, seed, least, room):
        seeds.append(seed)
        out = real(docs, parts, seed, least, room)
        return out if seed else out.union(spark.createDataFrame([(None, None, 7, None, None, None)], phrases.COUNTED))

    monkeypatch.setattr(phrases, "counted", counted)
    docs = spark.createDataFrame(ROWS, "lang string, text string")
    assert rows_of(phrases.collocations(docs)) == sorted(expected(ROWS)) and seeds == [0, 1]


def test_wide_partitions(monkeypatch):
    """A partition with more words than a key's bits can number is merged by two keys."""
    trie = phrases.HatTrie(1, 0)
    trie.add("en", [b"a", b"b", b"c", phrases.STOP] * 12)
    runs = pa.table({"run": [r[3] for r in trie.spilled(True)]})
    narrow = phrases.merged_runs(runs, 10).to_pylist()
    real = phrases.distinct
    monkeypatch.setattr(phrases, "distinct", lambda x: np.unique(np.append(real(x), np.arange(1 << 21, dtype=np.uint64))))
    wide = phrases.merged_runs(runs, 10).to_pylist()
    assert sorted(map(repr, wide)) == sorted(map(repr, narrow)) and len(wide) == 3


def test_large_counts_are_exact(spark):
    a, left, right = 999_999_999_999, 1_000_000_000_001, 999_999_999_999_999
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.score("a", "l", "r").alias("s"))
    assert df.first()["s"] == 1_000_000 * a * a // (left * right)
    most = 10**15 - 1
    assert spark.createDataFrame([(most, most, most)], "a long, l long, r long").select(phrases.score("a", "l", "r").alias("s")).first()["s"] == 1_000_000


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None, None)] * 3, docs.schema)).count() == 0
