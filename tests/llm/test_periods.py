"""Runs against brute force: small alphabets, planted periods, all scales."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provender.llm import periods
from provender.llm.common import table


def brute(x, least):
    """Every lag, every stretch: (start, end, smallest period)."""
    out = {}
    n = len(x)
    for q in range(1, n // 2 + 1):
        t = 0
        while t + q < n:
            if x[t] != x[t + q]:
                t += 1
                continue
            low = t
            while t + q < n and x[t] == x[t + q]:
                t += 1
            if t - low + q >= max(least, 2 * q):
                out.setdefault((low, t + q), q)
    return sorted((s, e, q) for (s, e), q in out.items())


def texts(seed, most=260):
    """Random words over few letters, powers, squares of powers, joined at random."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < most:
        letters = int(rng.choice([1, 2, 2, 3, 50]))
        part = list(rng.integers(0, letters, int(rng.integers(1, 30))))
        for _ in range(int(rng.integers(0, 3))):
            part = part * int(rng.integers(1, 5)) + part[: int(rng.integers(0, len(part) + 1))]
        out += part[:most]
        if rng.random() < 0.4:
            out += out[-int(rng.integers(1, len(out) + 1)) :]
    return out[: int(rng.integers(1, most + 1))]


@pytest.mark.parametrize("least, lags", [(2, 4), (4, 8), (8, 16), (12, 32)])
def test_runs_against_brute_force(least, lags):
    many = [texts(1000 * lags + s) for s in range(150)]
    x, sizes = [], []
    for k, t in enumerate(many):
        x += [*t, -1 - k]
        sizes.append(len(t) + 1)
    got = periods.runs_in(np.array(x, np.int64), np.array(sizes), least, lags)
    want, base = [], 0
    for t, size in zip(many, sizes):
        want += [(s + base, e + base, q) for s, e, q in brute(t, least)]
        base += size
    assert [tuple(r) for r in got.tolist()] == want


def test_long_periods():
    """A period of thousands of words in noise, and one made of powers of a shorter one."""
    rng = np.random.default_rng(5)
    unit = list(rng.integers(0, 10_000, 3000))
    power = [1, 2] * 700 + [1]
    x = [-9, *unit, *unit, *unit[:17], -8, *power, *power, -7]
    got = periods.runs_in(np.array([*x, -1]), np.array([len(x) + 1]))
    rows = {tuple(r) for r in got.tolist()}
    assert (1, 6018, 3000) in rows
    at = 1 + 6017 + 1
    assert {(at, at + 1401, 2), (at + 1401, at + 2802, 2), (at, at + 2802, 1401)} <= rows
    odd = [q for s, e, q in rows if s >= at and q not in (2, 3000)]
    assert sorted(odd) == list(range(7, 1402, 2))  # every odd period about the seam, from 2 q >= 12 on


def expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    names = {}
    rows = [(s, e - s, q) for s, e, q in brute([names.setdefault(w, len(names)) for w in words], 12)]
    gone = {i for s, length, q in rows for i in range(s + q, s + length)}
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in rows).encode()).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return len(rows), *best, best[1] and 1000 * best[1] // best[2], digest, hashlib.sha256(kept).hexdigest()


def test_query(spark, sf_dir):
    """Whole texts, with what the query plants, against brute force; those of 3,000 words or more by their planted run."""
    got = {r["doc_id"]: tuple(r)[1:] for r in periods.op12_periods(spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    assert got.keys() == docs.keys()
    short = {i: t for i, t in docs.items() if len((t or "").split()) < 3000}
    assert len(short) > 180 and sum(got[i][0] > 0 for i in short) > 10
    for i, t in short.items():
        assert got[i] == expected(i, t), i


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, columns of the same names; however rows are dealt."""
    long = " ".join([*(f"w{i}" for i in range(50_000)), *(f"w{i}" for i in range(25_000, 50_000))])
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 11), (5, "a " * 12), (6, "a\x0bb c d " * 9), (7, long), (None, "x y " * 8), (8, "r s t " * 5), (8, "r s t " * 5), ((1 << 60) + 1, "é 日本 " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("period", "runs", "_runs", "_in", "lang")})
    out = periods.periodic_runs(docs.repartition(3))
    got = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["lang"], r["_in"]) for r in out.collect()}
    assert got == {(1, 0, *[None] * 4, "own", "own"), (2, 0, *[None] * 4, "own", "own"), (3, 0, *[None] * 4, "own", "own"), (4, 0, *[None] * 4, "own", "own"), (5, 1, 0, 12, 1, 12000, "own", "own"), (6, 1, 0, 27, 3, 9000, "own", "own"), (7, 1, 25_000, 50_000, 25_000, 2000, "own", "own"), (None, 1, 0, 16, 2, 8000, "own", "own"), (8, 1, 0, 15, 3, 5000, "own", "own"), ((1 << 60) + 1, 1, 0, 14, 2, 7000, "own", "own")}
    assert out.count() == len(rows) and periods.periodic_runs(docs.limit(0)).count() == 0
    kept = {r["doc_id"]: r["collapsed"] for r in out.collect()}
    assert kept[1] == "" and kept[5] == "a" and kept[8] == "r s t" and kept[4] == " ".join("a" * 11)
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, least=12, lags=16)
