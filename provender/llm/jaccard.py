"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct five-word shingles. Under one order of all shingles, two sets
of similarity t or more share a shingle among the first |x| - ceil(t |x|) + 1 of each: its prefix.
Rare shingles come first in the order, so prefixes seldom hold what many documents share.
Documents with the same prefix and size form one group. Groups that share a prefix shingle gather
in families around the one most like all; group pairs are filtered by size and by what is known to
hang together already, then expanded, and their members verified by exact set sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, among, components, distinct, forest, settled, table, texts_of, windows

WORDS, PERCENT = 5, 80
#: The share of a document's shingles, those with the smallest hashes, whose frequency is counted.
ZONE = 0.3
#: Tokens in prefixes are the upper 48 bits of a shingle's hash; verification has all 64.
SHIFT = 16


def shingles(text: bytes, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words; of fewer words, the whole sequence is one."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone parts words
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(h) < width:
        return windows(np.append(h, np.uint64(len(h))), len(h) + 1)
    return distinct(windows(h, width))


def prefix_size(n: Column) -> Column:
    """|x| - ceil(t |x|) + 1, in integers."""
    return (n - F.expr(f"({PERCENT} * n + 99) div 100") + 1).cast("int")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sig, zone) of each document: its set's size and hash, and its smallest tokens.

    zone holds the tokens under the ZONE share of all values, or as many as the prefix has if those
    are fewer; they come before all others in the order. Ids stay Arrow columns: pandas would make
    those beside a null floats.
    """
    edge = int(ZONE * (1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                s = shingles(text, hashes)
                n = len(s)
                take = max(int(np.searchsorted(s, np.uint64(edge))), n - (PERCENT * n + 99) // 100 + 1) if n else 0
                rows.append((n, xxhash.xxh3_128_digest(s.tobytes()), (s[:take] >> np.uint64(SHIFT)).astype(np.int64)))
            sizes = np.cumsum([0, *(len(r[2]) for r in rows)])
            zones = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(r[2] for r in rows)])))
            columns = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), zones]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sig", "zone"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n int, sig binary, zone array<long>")


def prefixes(sets: DataFrame) -> DataFrame:
    """(doc_id, n, skip, prefix): the tokens of each prefix that other documents have too, in order.

    The order is by frequency in the zones, then by value; tokens beyond the ZONE share come last,
    by value. Tokens that one document alone has come first and link with nothing: skip says how
    many of them the prefix holds at least. A prefix that reaches beyond the zone has all its tokens here.
    """
    edge = int(ZONE * (1 << 64)) >> SHIFT
    posted = sets.where("n > 0").select("doc_id", F.expr("n * 4294967296L + size(zone)").alias("sizes"), F.explode("zone").alias("token"))
    shared = settled(posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    rows = posted.join(shared, "token").groupBy("doc_id", "sizes").agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("token") < edge, F.col("df")).otherwise(1 << 62).alias("df"), "token"))).alias("t"))
    rows = rows.select("doc_id", F.shiftright("sizes", 32).cast("int").alias("n"), (F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1)).cast("int") - F.size("t")).alias("skip"), "t")
    rows = rows.withColumn("left", prefix_size(F.col("n")) - F.col("skip")).where("left > 0")
    skip = F.when(F.col("skip") + F.size("t") > prefix_size(F.col("n")), F.col("skip")).otherwise(0)
    return rows.select("doc_id", "n", skip.alias("skip"), F.slice("t.token", F.lit(1), F.col("left")).alias("prefix"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts (doc_id, text as bytes) whose sets have the similarity asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, held = WordHashes(), None, None
        for pdf in batches:
            keep = []
            for b, x, y in zip(pdf["b"], pdf["x"], pdf["y"]):
                if b != last:
                    last, held = b, shingles(y, hashes)
                s = shingles(x, hashes)
                common = len(np.intersect1d(s, held, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(s) + len(held) - common))
            yield pdf.loc[keep, ["a", "b"]]

    x, y = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def families_met(tokens: DataFrame, most: int = 512, bucket: int = 512) -> DataFrame:
    """(host, f, k): pairs of families that a token brings together, the members of the smaller to visit the larger (k members).

    tokens: token, f, and of each family k (members), low and high (least and greatest component), small and
    large (sizes of sets). Pairs that hang together already, or whose sizes are too unlike, are left out before
    they are rows. A token of over ``most`` families is dealt into buckets, and buckets are compared within tasks.
    """
    own = ["f", "k", "low", "high", "small", "large"]
    many = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rows = tokens.join(many, "token")
    one, two = (rows.where(f"n between 2 and {most}").select("token", *(F.col(c).alias(c + s) for c in own)) for s in "12")
    open_ = F.expr(f"f1 < f2 and not (low1 = high1 and low2 = high2 and low1 = low2) and 100 * large1 >= {PERCENT} * small2 and 100 * large2 >= {PERCENT} * small1")
    at_home = F.expr("k1 > k2 or (k1 = k2 and f1 < f2)")
    few = one.join(two, "token").where(open_).select(F.when(at_home, F.col("f1")).otherwise(F.col("f2")).alias("host"), F.when(at_home, F.col("f2")).otherwise(F.col("f1")).alias("f"), F.greatest("k1", "k2").alias("k"))

    hot = rows.where(f"n > {most}").withColumn("b", F.expr(f"cast(ceil(n / {bucket}) as int)")).withColumn("x", F.expr("cast(pmod(xxhash64(f), b) as int)"))
    hot = hot.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("token", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", *own)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        f, k, low, high, small, large, x = (pdf[c].to_numpy() for c in (*own, "x"))
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = np.flatnonzero(x == i), np.flatnonzero(x == j)
        near = (100 * large[a][:, None] >= PERCENT * small[b][None]) & (100 * large[b][None] >= PERCENT * small[a][:, None])
        near &= ~((low[a] == high[a])[:, None] & (low[b] == high[b])[None] & (low[a][:, None] == low[b][None]))
        near &= (f[a][:, None] < f[b][None]) if i == j else (f[a][:, None] != f[b][None])
        p, q = np.nonzero(near)
        p, q = a[p], b[q]
        home = (k[p] > k[q]) | ((k[p] == k[q]) & (f[p] < f[q]))
        return pd.DataFrame({"host": np.where(home, f[p], f[q]), "f": np.where(home, f[q], f[p]), "k": np.maximum(k[p], k[q])})

    return few.union(hot.groupBy("token", "i", "j").applyInPandas(pairs, "host long, f long, k long")).distinct()


def between(members: DataFrame, tokens: DataFrame, texts: DataFrame, chunk: int = 256) -> DataFrame:
    """Links (a, b) that join different components among members (doc_id, n, c: component, f: family).

    tokens (token, f) says which families meet. A family is compared with itself if it has several
    components, and with all members of smaller families that meet it, in chunks against chunks
    within tasks: pairs are never rows. What is in its head's component isn't compared with its like.
    """
    head = members.where("doc_id = f").select("f", F.col("c").alias("main"))
    role = settled(members.join(head, "f", "left").withColumn("rest", ~F.coalesce(F.col("c") == F.col("main"), F.lit(False))).drop("main"), "role")
    per = role.groupBy("f").agg(F.count("*").alias("k"), F.count_if("rest").alias("u"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("small"), F.max("n").alias("large"))
    per = settled(per, "families")
    met = families_met(settled(tokens.join(per.drop("u"), "f"), "tokens"))
    visitors = settled(role.join(settled(met, "families_met"), "f").select("host", "k", "doc_id", "n", "c"), "visitors")
    hosts = settled(visitors.groupBy("host", "k").agg(F.count("*").alias("v")), "hosts")

    hashed = "cast(pmod(xxhash64(doc_id), {}) as int)"
    unit = ["f", "guests", "i", "j"]

    def chunks(n: str) -> str:
        return f"cast(ceil({n} / {chunk}) as int)"

    def against(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.expr(chunks(n)) - 1))

    home = role.join(hosts.select(F.col("host").alias("f"), "k", "v"), "f").withColumn("i", F.expr(hashed.format(chunks("k")))).withColumn("j", against("v"))
    guest = visitors.join(hosts.select("host", "v"), "host").withColumn("j", F.expr(hashed.format(chunks("v")))).withColumn("i", against("k")).withColumn("f", F.col("host"))
    sides = [x.select("f", F.lit(True).alias("guests"), "i", "j", F.lit(right).alias("right"), "doc_id", "n", "c") for x, right in ((home, False), (guest, True))]
    mixed = per.where("low <> high and u > 0").select("f", F.expr(chunks("(k - u)")).alias("m"), F.expr(chunks("u")).alias("r"))
    inside = role.join(settled(mixed, "mixed"), "f").withColumn("x", F.when(F.col("rest"), F.col("m") + F.expr(hashed.format("r"))).otherwise(F.expr(hashed.format("greatest(m, 1)"))))
    inside = inside.withColumn("y", F.explode(F.sequence(F.when(F.col("rest"), 0).otherwise(F.col("m")), F.col("m") + F.col("r") - 1)))
    sides.append(inside.select("f", F.lit(False).alias("guests"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).alias("right"), "doc_id", "n", "c"))
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    parts = max(128, role.count() // 100)
    rows = rows.join(texts, "doc_id").withColumn("part", F.expr(f"cast(pmod(xxhash64(f, guests, i, j), {parts}) as int)"))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, sets, out_a, out_b = WordHashes(), {}, [], []
        ids, n, c, right, text = (pdf[x].to_numpy() for x in ("doc_id", "n", "c", "right", "text"))
        for k, at in pdf.groupby(unit).indices.items():
            left, other = (at, at) if not k[1] and k[2] == k[3] else (at[~right[at]], at[right[at]])
            near = (100 * np.minimum.outer(n[left], n[other]) >= PERCENT * np.maximum.outer(n[left], n[other])) & (c[left][:, None] != c[other][None, :])
            if not near.any():
                continue
            for i in at:
                if ids[i] not in sets:
                    sets[ids[i]] = shingles(text[i], hashes)
            common = overlaps([sets[ids[i]] for i in left], [sets[ids[i]] for i in other])
            x, y = np.nonzero(near & (100 * common >= PERCENT * (n[left][:, None] + n[other][None, :] - common)))
            if len(x):
                a, b = forest(ids[left[x]], ids[other[y]])
                out_a.append(a)
                out_b.append(b)
        return pd.DataFrame({"a": np.concatenate([*out_a, np.zeros(0, np.int64)]), "b": np.concatenate([*out_b, np.zeros(0, np.int64)])})

    return rows.groupBy("part").applyInPandas(compared, "a long, b long")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a and each set of b have in common."""
    if len(a) * len(b) <= 8:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.int64).reshape(len(a), len(b))
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, len(shared), 1 << 14):
        part = shared[i : i + (1 << 14)]
        x, y = (np.array([among(s, part) for s in sets], np.float32) for sets in (a, b))
        out += x @ y.T
    return out.astype(np.int64)


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Texts with no words, or null, have no shingles and link with nothing; of fewer than five words
    the whole sequence is the one shingle. Long texts count whole. doc_id should tell documents
    apart: rows that repeat an id get the class of that id, and a null id links with nothing. Equal
    sets are one class of copies, represented by their smallest doc_id. An empty table gives an
    empty one.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = settled(digests(docs), "sets")
    named = sets.where("doc_id is not null and n > 0")
    copies = settled(named.groupBy("n", "sig").agg(F.min("doc_id").alias("rep")), "copies")

    members = settled(prefixes(named), "prefixes")
    key = [F.col("n"), F.xxhash64("prefix").alias("k1"), F.xxhash64(F.lit(1), "prefix").alias("k2")]
    keyed = members.select("doc_id", "skip", "prefix", *key)
    groups = settled(keyed.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("g"), F.first("prefix").alias("prefix"), F.min("skip").alias("skip")), "groups")
    in_group = settled(keyed.select("doc_id", "n", "k1", "k2").join(groups.select("n", "k1", "k2", "g"), ["n", "k1", "k2"]).select("doc_id", "g"), "in_group")
    # of the copies of a set, the representative alone is compared
    reps = settled(in_group.join(copies.select(F.col("rep").alias("doc_id")), "doc_id"), "reps")

    # Each token that several groups have leads to the one of them with the least share of shingles
    # of its own: of many edited copies, most likely the text they were made from.
    posted = groups.select("g", "n", (F.col("skip") / F.col("n")).alias("own"), F.explode("prefix").alias("token"))
    heads = posted.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("own", "g")).alias("head")).where("c > 1").drop("c")
    index = settled(posted.drop("own").join(settled(heads, "heads"), "token"), "index")
    family = settled(index.groupBy("g").agg(F.min("head").alias("head")).select("g", F.col("head.g").alias("f")), "family")

    # First, links of a group's members to its first one, and of that to the head of its family.
    texts = settled(docs.join(reps.select("doc_id").distinct().hint("merge"), "doc_id").withColumn("text", F.col("text").cast("binary")), "texts")
    star = family.where("g <> f").select(F.col("g").alias("a"), F.col("f").alias("b"))
    inner = reps.where("doc_id <> g").select(F.col("doc_id").alias("a"), F.col("g").alias("b"))
    edges = settled(verified(inner.union(star), texts), "star")

    # Then whatever else could join two components, family by family.
    known = components(edges).withColumnRenamed("id", "doc_id")
    sizes = groups.select("g", "n")
    members = reps.join(known, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).join(sizes, "g")
    members = settled(members.join(family, "g", "left").select("doc_id", "n", "c", F.coalesce("f", "g").alias("f")), "members")
    more = settled(between(members, index.join(family, "g").select("token", "f").distinct(), texts), "more")
    whole = components(settled(edges.union(more), "all"))

    named = sets.select("doc_id", "n", "sig")
    of = copies.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("n", "sig", F.coalesce("component", "rep").alias("component_id"))
    out = named.where("doc_id is not null and n > 0").join(settled(of, "of"), ["n", "sig"]).select("doc_id", "n", "component_id")
    alone = named.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.union(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS total, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, total, i, string_agg(x, ' ') OVER r AS s, count(*) OVER r AS n FROM p WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, md5(s) AS s FROM k WHERE n = 5 OR (total < 5 AND i = 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM j JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * j.n >= 80 * (x.n + y.n - j.n)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(c.n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN c USING (doc_id)
"""
