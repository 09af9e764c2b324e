"""The corpus operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provender.llm import embeddings, fingerprints, html, jaccard, lines, mixing, packing, quality, sharding, substrings
from provender.llm.common import components, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, copies and near copies."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 60))
    near = base.copy()
    near[30] = "changed"
    rows = [(0, None, None), (1, "", "a"), (2, " \n\t ", "a"), (3, "one", "a"), (4, "ONE", "a"), (5, "one two", None), (6, " ".join(base), "a"), (7, " ".join(near), "b"), (8, " ".join(base).upper(), "b"), (9, " ".join(rng.choice(words, 30_000)), "a"), (10, "x " * 50, "a"), (11, "x  " * 60, "c"), (12, "é ünï 日本 🙂", "c")]
    rows += [(100 + i, " ".join(base[: 40 + i]), "d") for i in range(20)]
    return docs_of(spark, rows).repartition(3).cache()


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def check_jaccard(docs):
    got = jaccard.jaccard_classes(docs).toPandas().set_index("doc_id")
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    assert got["component_id"].to_dict() == want
    assert got["n_shingles"].to_dict() == {i: len(s) for i, s in sets.items()}


def test_jaccard_odd(odd):
    check_jaccard(odd)


def test_jaccard_documents(spark, sf_dir):
    check_jaccard(table(spark, sf_dir, "documents"))


def test_jaccard_edited_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = base.copy()
        for k in rng.choice(120, rng.integers(0, 12), replace=False):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w), "s"))
    check_jaccard(docs_of(spark, rows))


def test_families_met(spark):
    """Hot tokens in buckets and others by a join give the pairs of families that brute force gives."""
    rng = np.random.default_rng(8)
    fam = {f: (int(rng.integers(1, 4)), *(sorted(int(x) for x in rng.integers(0, 3, 2)) if f % 2 else [f + 10, f + 10]), *sorted(int(x) for x in rng.integers(10, 40, 2))) for f in range(60)}
    at = {(t, f) for t in range(20) for f in rng.choice(60, 50 if t < 3 else 6)}
    rows = [(t, int(f), *fam[f]) for t, f in at]
    df = spark.createDataFrame(rows, "token long, f long, k long, low long, high long, small int, large int")
    want = set()
    for t, a in at:
        for u, b in at:
            (k1, l1, h1, s1, g1), (k2, l2, h2, s2, g2) = fam[a], fam[b]
            if t == u and a < b and not (l1 == h1 == l2 == h2) and 100 * g1 >= 80 * s2 and 100 * g2 >= 80 * s1:
                home = k1 > k2 or k1 == k2
                want.add((int(a if home else b), int(b if home else a), max(k1, k2)))
    for most, bucket in ((512, 512), (10, 7), (1, 50)):
        assert {tuple(r) for r in jaccard.families_met(df, most, bucket).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}


def brute_substrings(rows, width=13):
    first = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_substrings(spark, sf_dir, odd, which):
    docs = odd if which == "odd" else table(spark, sf_dir, "documents")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(docs).collect()}
    assert got == brute_substrings([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("shape", [{"cells": 1e-4, "depth": 1}, {"cells": 1e-4}, {"depth": 5}, {"block_bytes": 2000}])
def test_substrings_any_sketch(spark, odd, shape):
    """A sketch far too small, or blocks of a few documents, lose nothing."""
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(odd, **shape).collect()}
    assert got == brute_substrings([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])


def test_sketch_never_counts_less():
    key = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    key = np.concatenate([key, key[:300]])
    for bits in (4, 10, 20):
        own = substrings.counters(key, 3, bits)
        assert len(np.unique(own % 3)) == 3 and (own < 3 << bits).all() and (own[:, :300] == own[:, 5000:]).all()
        sums = np.bincount(own.ravel().astype(np.int64), minlength=3 << bits)
        least = sums[own.astype(np.int64)].min(0)
        assert (least[:300] >= 2).all() and (least >= 1).all()
        if bits == 20:
            assert (least[300:5000] > 1).mean() < 0.02


def test_substrings_null_ids(spark):
    w = " ".join(f"w{i}" for i in range(20))
    got = substrings.dedup(spark.createDataFrame([(None, w), (5, w), (5, w)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 20), (5, 0), (5, 0)]


M64 = (1 << 64) - 1


def spread_bits(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & M64
    return h ^ (h >> 31)


def plain_print(text):
    """The fingerprint by its definition, bit by bit: pairs of words vote by their hash's bits."""
    h = [xxhash.xxh3_64_intdigest(w) for w in text.encode().split()]
    terms = [spread_bits((a * 0x9E3779B97F4A7C15 + b) & M64) for a, b in zip(h, h[1:])] if len(h) > 1 else h
    out = []
    for half in range(2):
        for byte in range(8):
            for bit in range(7, -1, -1):
                ones = sum(spread_bits((t + half) & M64) >> (8 * byte + bit) & 1 for t in terms)
                out.append(2 * ones > len(terms))
    return bytes(sum(b << 7 - i for i, b in enumerate(out[k : k + 8])) for k in range(0, 128, 8)).hex()


def plain_likeness(a, b):
    apart = bin(int(a, 16) ^ int(b, 16)).count("1")
    return max(0.0, math.cos(math.pi * apart / 128))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_fingerprints(spark, sf_dir, odd, which):
    docs = odd if which == "odd" else table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r["doc_id"]: r for r in fingerprints.with_next(rows, each=7).collect()}
    made = {r["doc_id"]: bytes(r["edited"]).decode() for r in fingerprints.edited_prints(fingerprints.neighbours(rows)).collect()}
    order = sorted(got, reverse=True)
    for i, d in enumerate(order):
        text, following = got[d]["text"], got[order[(i + 1) % len(order)]]["text"]
        half = len(text) // 2
        assert got[d]["next_text"] == following and made[d] == text[: len(text) - half] + following[:half]


def test_fingerprint_query(spark, sf_dir):
    """Every column of the query by its definition."""
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: r for r in fingerprints.op9_fingerprints(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    order = sorted(docs, reverse=True)
    prints = {d: plain_print(t) for d, t in docs.items()}
    for i, d in enumerate(order):
        text, after = docs[d], order[(i + 1) % len(order)]
        half = len(text) // 2
        changed = text[: len(text) - half] + docs[after][:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), prints[d], plain_print(changed))
        assert r["near_edited"] == pytest.approx(plain_likeness(prints[d], plain_print(changed)), abs=1e-12) and r["near_next"] == pytest.approx(plain_likeness(prints[d], prints[after]), abs=1e-12)
        want = sum(bin(int(prints[d], 16) ^ int(p, 16)).count("1") <= fingerprints.RADIUS for p in prints.values()) - 1
        assert r["n_near"] == (want if d % 100 == 0 else None)


def test_neighbours_of_equal_and_null_ids(spark):
    rows = [(None, "n1"), (None, "n2"), (5, "b"), (5, "a"), (5, "a"), (9, "z"), (-3, None)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_tie", "_id", "_block", "_added", "_in", "_of", "_e")}).repartition(3)
    for each in (1, 4, 100):
        got = fingerprints.with_next(docs, each=each)
        assert set(docs.columns) <= set(got.columns)
        got = got.collect()
        assert len(got) == 21 and all(r["_tie"] == r["_id"] == r["_block"] == r["_added"] == r["_in"] == r["_of"] == 1 for r in got)
        after = {}
        for r in got:
            after.setdefault(r["doc_id"], []).append(r["next_text"])
        assert sorted(after[9]) == sorted(["z", "z"] + [x for x in after[9] if x in "ab"]) and sum(x in ("n1", "n2") for x in after[-3]) == 1
        assert sum(x == "z" for x in after[None]) == 1
        assert sorted((r["next_text"] or "") for r in got) == sorted((t or "") for _, t in rows * 3)  # a cycle: each follows once


def test_likeness_and_search(spark, sf_dir):
    prints = fingerprints.fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint").cache()
    bits = {r["doc_id"]: np.unpackbits(np.frombuffer(bytes.fromhex(r["fingerprint"]), np.uint8)) for r in prints.collect()}
    queries = prints.where("doc_id % 10 = 0")
    for radius in (3, 12):
        got = {(r["query_id"], r["doc_id"], r["distance"]) for r in fingerprints.near(queries, prints, radius).collect()}
        want = {(a, b, int((bits[a] != bits[b]).sum())) for a in bits if a % 10 == 0 for b in bits if a != b and (bits[a] != bits[b]).sum() <= radius}
        assert got == want
        n = {r["doc_id"]: r["n_near"] for r in queries.join(fingerprints.near_counts(queries, prints, radius), "fingerprint").collect()}
        assert n == {a: sum(x == a for x, _, _ in want) for a in bits if a % 10 == 0}


def test_packing(spark, sf_dir, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd.unionByName(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(docs_of(spark, [(5000, "a<|endoftext|>b  \n\n c's 12", "a")]))
    cuts = packing.pieces(docs).cache()
    got = packing.pack(cuts).toPandas()
    for r in table(spark, "/root/testdata/sf0.01", "documents").collect():  # the faster library against the one whose file this is
        assert packing.ids_of(r["text"] or "", packing.vocabulary_path()).tolist() == [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for doc, part in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(part["ids"]) == ids.tobytes()
        assert part["start"].tolist() == np.cumsum([0, *part["length"]])[:-1].tolist()
        assert all(part["length"].iloc[1:] == 1024)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == np.cumsum([0, *part["length"]])[:-1].tolist() and part["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 1024) * 1.02 + 1


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    length = [rng.integers(1, 1025, 4000), rng.integers(250, 400, 3000), np.full(500, 700), rng.geometric(0.01, 4000).clip(1, 1024)][seed]
    counts = np.bincount(length, minlength=1025)
    runs, fill, ranks = packing.plan(counts), {}, {}
    for n, rank, k, first, offset in runs:
        for i in range(k):
            fill.setdefault(first + i, []).append((offset, n))
            ranks.setdefault(n, []).append(rank + i)
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items()) and sum(map(len, ranks.values())) == len(length)
    for places in fill.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 1024


def test_sharding(spark, sf_dir, odd):
    got = sharding.op6_sharding(spark, sf_dir).toPandas().merge(table(spark, sf_dir, "documents").toPandas())
    assert (got["size"] == got["text"].map(lambda t: len(t.encode()) + 8)).all() and (got["text_crc32"] == got["text"].map(lambda t: zlib.crc32(t.encode()))).all()
    n = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert n.max() - n.min() <= 1 and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    few = sharding.shards(odd.select("doc_id", "lang", "source", "n_chars"), ["lang", "source", "n_chars"], 50, ["doc_id"]).toPandas()
    assert few["shard"].is_unique and (few["slot"] == 0).all()


def plain_hilbert(x, y, bits):
    """The classic walk down the quadrants of a square."""
    d, n = 0, 1 << bits
    s = n // 2
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s //= 2
    return d


def test_order_along_the_curve(spark):
    """Shards and slots are the order of the curve, worked out cell by cell in two dimensions."""
    square = np.array([(x, y) for x in range(32) for y in range(32)])
    curve = {tuple(int(v) for v in c): int(h) for c, h in zip(square, sharding.hilbert(square, 5))}
    plain = {c: plain_hilbert(c[0], c[1], 5) for c in curve}
    assert curve in (plain, {(x, y): h for (y, x), h in plain.items()})  # the curve, or its mirror image
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3000)), int(rng.integers(0, 50))) for i in range(700)] + [(700, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, size long, n long").repartition(3)
    got = sharding.shards(df, ["size", "n"], 9, ["doc_id"]).collect()

    def cell(v):
        return 0 if v is None else min(255, int(8 * math.log2(v + 1)))

    index = {i: int(sharding.hilbert(np.array([[cell(a), cell(b)]]))[0]) for i, a, b in rows}
    order = sorted(index, key=lambda i: (index[i], i))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == order
    assert {r["doc_id"]: r["curve"] for r in got} == index
    runs = np.diff([-(-s * len(rows) // 9) for s in range(10)])
    assert [sum(r["shard"] == s for r in got) for s in range(9)] == runs.tolist()


def test_hilbert_steps():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(at := sharding.hilbert(cells, 3))
    assert sorted(at) == list(range(512)) and (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_copies_are_on_one_side(monkeypatch):
    """The temperature isn't fitted on texts that were trained on: of many copies all are aside, or none."""
    seen = {}
    real = quality.Model.logits

    def logits(self, x):
        seen["aside"] = len(x)
        return real(self, x)

    monkeypatch.setattr(quality.Model, "logits", logits)
    texts = [f"copy {i % 4} of a text" for i in range(80)]
    quality.fit(texts, np.arange(80) % 2, epochs=1)
    assert seen.get("aside", 0) % 20 == 0
    quality.fit(["one text"] * 30, np.arange(30) % 2, epochs=1)


def brute_lines(rows, ratio, distinct):
    """The rule by its definition: on k of a host's n pages, line by line, four at least."""
    hosts = {}
    for i, t, h in rows:
        hosts.setdefault(h, []).append(t)
    gone = {}
    for h, texts in hosts.items():
        texts = list(dict.fromkeys(texts)) if distinct else texts
        on = {}
        for t in texts:
            for x in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
                on[x] = on.get(x, 0) + 1
        gone[h] = {x for x, k in on.items() if k >= 4 and k > ratio * len(texts)}
    out = {}
    for i, t, h in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if x.strip(" ") not in gone[h]]
        out[i] = ("\n".join(kept), len(split), len(split) - len(kept))
    return out


@pytest.mark.parametrize("distinct", [False, True])
def test_lines(spark, distinct):
    rows = [(i, f"menu\nown {i}\n\n foot ", "a") for i in range(20)] + [(50 + i, "copy\nmenu", "a") for i in range(30)] + [(90, None, None), (91, "menu\nx", "b"), (92, "", "b"), (93, "only page\nof its host", "c"), (94, "both\none", "d"), (95, "both\ntwo", "d")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_boilerplate(docs_of(spark, rows), distinct=distinct).collect()}
    assert got == brute_lines(rows, lines.RATIO, distinct)
    assert got[60] == ("copy", 2, 1) if distinct else got[60] == ("", 2, 2)
    assert got[93] == ("only page\nof its host", 2, 0) and got[94] == ("both\none", 2, 0)
    alone = {r["doc_id"]: r["n_dropped"] for r in lines.drop_boilerplate(docs_of(spark, rows), distinct=distinct, least=2).collect()}
    assert alone[94] == alone[95] == 1 and alone[93] == 0


@pytest.mark.parametrize("distinct", [False, True])
def test_lines_of_documents(spark, distinct):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_boilerplate(docs, distinct=distinct).collect()}
    assert got == brute_lines(rows, lines.RATIO, distinct) and sum(x[2] for x in got.values())


def test_lines_standing(spark):
    rows = [(1000 * h + i, f"own {h} {i}" + "\nstanding" * (i < on) + "\nnow and then" * (i < 8), f"h{h}") for h, on in enumerate((17, 20, 26)) for i in range(200)]
    got = lines.drop_boilerplate(docs_of(spark, rows)).groupBy("source").agg(F.sum("n_dropped").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"h0": 17, "h1": 20, "h2": 26}  # 8.5, 10 and 13 % of the pages


def test_mixing(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents")
    got = mixing.mix(docs, repeats=1.5).toPandas()
    tokens = docs.toPandas().assign(n=lambda d: d["text"].map(lambda t: len(t.split()))).groupby("source")["n"].sum()
    taken = got.groupby("source")["n_tokens"].sum()
    assert set(got["doc_id"]) == set(range(len(docs.toPandas()))) and (taken / tokens).max() <= 1.5 + 0.2
    assert not got.duplicated(["doc_id", "epoch"]).any()
    assert len(mixing.mix(odd).select("doc_id").distinct().collect()) == odd.count()
    half = mixing.mix(docs, repeats=None, entropy=1.0, budget=int(tokens.sum() / 2)).toPandas()
    share = half.groupby("source")["n_tokens"].sum() / (tokens.sum() / 2)
    assert (abs(share - 1 / len(tokens)) < 0.05).all()  # the last document of each may reach over


@pytest.mark.parametrize("target", [{"repeats": 3.0}, {"repeats": None, "entropy": 0.97}, {"repeats": None, "entropy": 0.99, "budget": 60_000}])
def test_mixing_by_hand(spark, target):
    """The rows drawn, their blocks and places, and where each source ends, worked out one by one."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "abcde"[int(rng.choice(5, p=[0.5, 0.2, 0.15, 0.1, 0.05]))]) for i in range(1500)] + [(5000 + i, "", "empty") for i in range(3)]
    docs = docs_of(spark, rows)
    got = {(r["doc_id"], r["epoch"]): (r["block"], r["place"]) for r in mixing.mix(docs, block=100, **target).collect()}
    tokens = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcde"}
    total = sum(tokens.values())

    def weights(x):
        w = {s: (n / total) ** x for s, n in tokens.items()}
        return {s: v / sum(w.values()) for s, v in w.items()}

    def met(x):
        if target.get("repeats"):
            return (min(tokens.values()) / max(tokens.values())) ** (x - 1) > target["repeats"]
        p = list(weights(x).values())
        return -sum(v * math.log(v) for v in p) >= target["entropy"] * math.log(5)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if met(mid) else (low, mid)
    w = weights(low)
    scale = target.get("budget") or max(tokens[s] / w[s] for s in w)
    hashes = {(r["doc_id"], r["e"]): (r["b"], r["p"]) for r in docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("e")).select("doc_id", "e", F.expr(f"xxhash64(doc_id, e, {mixing.SEED})").alias("b"), F.expr(f"xxhash64(doc_id, e, {mixing.SEED + 1})").alias("p")).collect()}
    want = {}
    for s in "abcde":
        own = [(i, len(t.split())) for i, t, x in rows if x == s]
        blocks = -(-len(own) // 100)
        times = w[s] * scale / tokens[s]
        whole = int(times + 1e-9)
        for e in range(whole + 1):
            taken = 0
            for i, n in sorted(own, key=lambda d: (hashes[d[0], e][0] % blocks, hashes[d[0], e][1], d[0])):
                if e < whole or taken < (times - whole) * tokens[s] - 1e-6:
                    want[i, e] = (hashes[i, e][0] % blocks, hashes[i, e][1])
                taken += n
    want |= {(5000 + i, 0): (0, hashes[5000 + i, 0][1]) for i in range(3)}
    assert got == want


def test_mixing_exponent(spark):
    sources = spark.createDataFrame([(t,) for t in (1000, 100, 10)], "tokens long")
    x = mixing.exponent(sources, repeats=4.0)
    assert abs((10 / 1000) ** (x - 1) - 4) < 1e-6
    x = mixing.exponent(sources, entropy=0.8, repeats=None)
    p = np.array([1000, 100, 10.0]) ** x
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.8) < 1e-6
    assert mixing.exponent(sources, entropy=0.01, repeats=None) == 1.0


def test_word_vectors_of_all_texts():
    rng = np.random.default_rng(2)
    texts = ["copy of one text " * 3] * 700 + [" ".join(rng.choice(["stone", "water", "tree"], 12)) for _ in range(100)] + ["long " * 300_000]
    cells = quality.Cells()
    all_at_once, alone = quality.word_vectors(texts, cells), quality.word_vectors(texts[:700], cells)
    at = cells["stone"]
    assert not np.allclose(all_at_once[at], alone[at])
    model = quality.fit(texts, np.arange(len(texts)) % 2, epochs=1)  # fit learns from all of them, not from the first ones
    assert np.allclose(model.vectors, all_at_once)


def plain_score(m, text):
    """A score by its definition: each token of the text in turn."""
    total, n = m.prior.astype(np.float64) * quality.PRIOR, quality.PRIOR
    for token in quality.tokens(text):
        total = total + m.vectors[xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) % quality.CELLS]
        n += 1
    x = ((total / n if n > quality.PRIOR else m.prior) - m.mean) / m.scale
    hidden = [math.tanh(sum(x[i] * m.w1[i, j] for i in range(quality.DIM)) + m.b1[j]) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, m.w2)) + m.b2) / m.temperature))


def test_scores_by_hand(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    for rows in (docs.limit(40), odd):
        for r in quality.classify(rows, model).collect():
            assert r["score"] == pytest.approx(plain_score(model, r["text"] or ""), abs=1e-5)


def test_word_vectors_by_hand():
    """A token's vector: the index vectors of the tokens up to NEAR words away, each time they stand there, and its own."""
    texts = ["one two three two", "Four 5 !! one", ""]
    index, sums, cells = quality.index_vectors(), {}, quality.Cells()
    for text in texts:
        at = [cells[t] for t in quality.tokens(text)]
        for i, a in enumerate(at):
            for j, b in enumerate(at):
                if i != j and abs(i - j) <= 2 * quality.NEAR:
                    sums[a] = sums.get(a, 0) + index[b].astype(np.float64)
    got = quality.word_vectors(texts, cells)
    for a in range(quality.CELLS):
        own = index[a] / quality.SEEDS**0.5
        want = own + sums[a] / np.linalg.norm(sums[a]) if a in sums and np.linalg.norm(sums[a]) else own
        if a in sums or a < 50:
            assert np.allclose(got[a], want, atol=1e-5)


def test_fit_takes_the_sample_whole(spark):
    """No more than ``sample`` documents are fitted on, and the same ones however rows are dealt and repeated."""
    rows = [(i, f"text {i} " * 5, "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda texts, y: seen.append((texts, y.tolist()))
    try:
        quality.fit_on(docs_of(spark, rows), labels, 50)
        quality.fit_on(docs_of(spark, rows * 3).repartition(7), labels.union(labels), 50)
        quality.fit_on(docs_of(spark, rows), labels, 4000)
    finally:
        quality.fit = fit
    held = sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400))
    assert len(seen[0][0]) == 50 and seen[0] == seen[1] and len(seen[2][0]) == 400 - held


def test_quality(spark, sf_dir, odd):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    model = quality.fit_on(docs, labels)
    got = quality.classify(docs.join(labels, "doc_id"), model).withColumn("out", quality.held_out(F.col("doc_id"))).where("out").toPandas()
    assert ((got["score"] >= 0.7) == (got["quality"] == 1)).mean() >= 0.95
    scores = {r["doc_id"]: r["score"] for r in quality.classify(odd, model).collect()}
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1]


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 32))
    near = base[:10, None, :] + rng.normal(size=(10, 30, 32)) * 0.12
    x = np.concatenate([base, near.reshape(-1, 32), base[:5], base[:5] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [None] * 32), (9004, []), (9005, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings.near_vectors(df).toPandas()
    assert len(got) == len(rows)
    got = got.dropna(subset=["vec_id"]).set_index("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    n = got["n_links"].reindex(range(len(x))).to_numpy()
    assert (n <= near.sum(1)).all() and n.sum() >= 0.9 * near.sum()
    assert all(got["n_links"][i] == 0 and got["component_id"][i] == i for i in range(9000, 9006))
    assert (got["kept"] == (got.index == got["component_id"])).all()


@pytest.mark.parametrize("size", [8, 24, 64, 384])
@pytest.mark.parametrize("n", [10**3, 10**6, 10**9])
def test_recall_of_designs(size, n):
    """Planted pairs at the threshold and a little above are met by the tables chosen for n vectors."""
    d = embeddings.design(n, size, 0.9)
    rng = np.random.default_rng((3, size))
    a, b = rng.normal(size=(2, 600, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for cosine, least in ((0.9, 0.92), (0.93, 0.95), (0.97, 0.98)):
        near = cosine * a + np.sqrt(1 - cosine**2) * b
        assert embeddings.meet(embeddings.cells(a, d), embeddings.cells(near, d)).any(1).mean() >= least
    if n == 10**9 and size >= 64:  # unrelated vectors seldom meet
        other = np.roll(a, 1, axis=0)
        assert d.parts > 2 and embeddings.meet(embeddings.cells(a, d), embeddings.cells(other, d)).mean() < 1e-3


def test_embeddings_table(spark):
    """The given table with planted copies: links and classes against brute force over all pairs."""
    rng = np.random.default_rng(4)
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    top = max(i for i, _ in rows) + 1
    for k in range(150):  # near copies of chains and pairs, at cosines about 0.9 to 1
        v = rows[k % 60][1] if k < 100 else rows[-1][1]
        rows.append((top + k, v + rng.normal(size=len(v)) * np.linalg.norm(v) / len(v) ** 0.5 * rng.uniform(0.05, 0.45)))
    kind = table(spark, "/root/testdata/sf0.01", "embeddings").schema["embedding"].dataType.simpleString()
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"vec_id long, embedding {kind}")
    x = np.array([r["embedding"] for r in df.collect()], np.float64)
    ids = np.array([i for i, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 200
    want = roots([int(i) for i in ids], [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(np.triu(near)))])
    got = embeddings.near_vectors(df.withColumns({c: F.lit(1) for c in ("id", "cell", "_n", "_c", "kept", "size")})).toPandas().set_index("vec_id")
    assert (got["n_links"].reindex(ids).to_numpy() <= near.sum(1)).all() and got["n_links"].sum() >= 0.95 * near.sum()
    same = sum(got["component_id"][i] == c for i, c in want.items())
    assert same >= 0.98 * len(ids) and all(got["component_id"][i] >= c for i, c in want.items())  # never joins what brute force doesn't


def test_lattice():
    steps = embeddings.minimal_vectors()
    assert len(steps) == 240 and (np.square(steps).sum(1) == 8).all()
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    home = embeddings.nearest_e8(x)
    d = ((2 * x - home) ** 2).sum(1)
    assert all((((2 * x[:, None] - home[:, None] - steps[None]) ** 2).sum(2) >= d[:, None] - 1e-9).all(1))


@pytest.mark.parametrize("run", ["jaccard", "lines", "mixing", "pack", "sub", "prints", "html", "vec", "quality", "shards"])
def test_empty_tables(spark, run):
    docs = docs_of(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = lambda: quality.fit(["a b c", "!! ## !!"], np.array([1, 0]), epochs=2)
    jobs = {
        "jaccard": lambda: jaccard.jaccard_classes(docs), "lines": lambda: lines.drop_boilerplate(docs), "mixing": lambda: mixing.mix(docs), "pack": lambda: packing.pack(packing.pieces(docs)), "sub": lambda: substrings.dedup(docs),
        "prints": lambda: fingerprints.edited_prints(fingerprints.neighbours(docs)), "html": lambda: html.main_text(pages), "vec": lambda: embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        "quality": lambda: quality.classify(docs, model()), "shards": lambda: sharding.shards(docs.select("doc_id", "lang", "source"), ["lang", "source"], 4, ["doc_id"]),
    }
    assert jobs[run]().count() == 0


def test_pipeline(spark):
    """Each stage on all that the one before kept, with its decisions in effect."""
    import corpus_pipeline as p

    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").toPandas().set_index("doc_id")["quality"]
    seen = [docs.toPandas()]
    for name, stage in p.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas())
        seen.append(docs.toPandas())
        if name != "packing":
            assert docs.columns == p.COLUMNS
    first, good, cleaned, single, mix, packs = seen
    known = good["doc_id"].isin(labels.index)
    assert labels[good.loc[known, "doc_id"]].mean() > 0.97 and len(good) > 0.8 * len(first)
    assert set(cleaned["doc_id"]) == set(good["doc_id"])
    sets = {i: shingle_set(t) for i, t in zip(single["doc_id"], single["text"])}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[:k]}
    assert not [1 for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(mix["doc_id"]) == set(single["doc_id"])
    assert len(packs[packs["piece"] == 0]) == len(mix)
    digest = {hashlib.sha256(t.encode()).hexdigest() for t in mix["text"]}
    assert digest == {hashlib.sha256(t.encode()).hexdigest() for t in single["text"]}
