"""Embedding near-dedup by lattice hashing.

In each of several tables a vector is projected at random into eight dimensions, or several times
eight, and each eight are decoded to the nearest point of the E8 lattice: together these are its cell.
Near vectors share a cell, or a neighbouring one, which each vector probes as well. Vectors that meet
are compared by cosine in double precision. How many lattice points make a cell, how fine they are and
how many tables there are goes by the number of vectors, see ``design``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, settled, table

#: A pair at the threshold is to be met with a probability of RECALL; a row in a table costs as much as ROW comparisons.
RECALL, ROW, PROBES, SEED = 0.96, 1000, 3, 20


class Design(NamedTuple):
    """tables; parts: lattice points that make a cell; scale: how fine they are; probes: neighbouring cells looked into."""

    tables: int
    parts: int
    scale: float
    probes: int = PROBES


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row (Conway and Sloane, 1982), doubled so that it is integral.

    E8 is D8 and D8 shifted by a half; the nearest point of D8 rounds every coordinate and, if the
    sum is odd, rounds the worst one the other way.
    """

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        off = y - r
        worst = np.abs(off).argmax(1)
        rows = np.arange(len(y))
        odd = np.mod(r.sum(1), 2) == 1
        r[rows[odd], worst[odd]] += np.where(off[rows[odd], worst[odd]] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], 2 * a, 2 * b).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: steps to the neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (2, -2):
                for t in (2, -2):
                    v = [0] * 8
                    v[i], v[j] = s, t
                    out.append(v)
    for m in range(256):
        v = [1 - 2 * (m >> k & 1) for k in range(8)]
        if v.count(-1) % 2 == 0:
            out.append(v)
    return np.array(out, np.int64)


def coded(point: np.ndarray) -> np.ndarray:
    """64-bit codes of doubled lattice points in a row: odd weights keep points of eight apart but for chance."""
    weights = np.random.default_rng((SEED, point.shape[1])).integers(0, 1 << 62, point.shape[1]) * 2 + 1
    return (point * weights).sum(1)


def cells(unit: np.ndarray, d: Design, seed: int = SEED) -> np.ndarray:
    """n x tables x (1 + probes) codes: the home cell and the nearest neighbouring cells."""
    n, size, wide = len(unit), unit.shape[1], 8 * d.parts
    steps, out = minimal_vectors(), np.empty((n, d.tables, 1 + d.probes), np.int64)
    for t in range(d.tables):
        rng = np.random.default_rng((seed, size, d.parts, t))
        project = np.linalg.qr(rng.normal(size=(size, min(wide, size))))[0] * (d.scale * (size / 8) ** 0.5)
        shift = rng.uniform(0, 1, wide)
        for at in range(0, n, 2000):
            y = np.zeros((len(unit[at : at + 2000]), wide))
            y[:, : project.shape[1]] = unit[at : at + 2000] @ project
            y = (y + shift).reshape(-1, 8)
            home = nearest_e8(y)
            rows = home.reshape(-1, wide)
            out[at : at + 2000, t, 0] = coded(rows)
            if d.probes:
                # a step in one of the parts; it is the nearer the more it leads along the rest
                gain = ((2 * y - home) @ steps.T).reshape(len(rows), -1)
                best = np.argpartition(-gain, d.probes, axis=1)[:, : d.probes]
                for k in range(d.probes):
                    part, step = np.divmod(best[:, k], len(steps))
                    there = rows.reshape(-1, d.parts, 8).copy()
                    there[np.arange(len(rows)), part] += steps[step]
                    out[at : at + 2000, t, 1 + k] = coded(there.reshape(-1, wide))
    return out


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n x tables: whether the home of one is among the cells of the other."""
    return (b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)


def design(n: int, size: int, threshold: float, recall: float = RECALL, probes: int = PROBES) -> Design:
    """The tables and cells that compare n vectors at least cost.

    For cells of one lattice point (scale 1.5 or 2), two (1.25) or up to ten (1), pairs of vectors at the
    threshold are drawn to see how often a table brings them together, which says how many tables the
    recall needs; and unrelated ones, which says how many others a vector meets. Cost is a row for
    each cell of each vector, and what is met. The drawing is seeded: equal arguments give equal
    designs. The number of rows a vector has grows with some n ** 0.3, and no pair is left out by
    a limit.
    """
    rng = np.random.default_rng((SEED, size))
    a, b = rng.normal(size=(2, 1500, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    c = min(threshold, 1.0)
    near = c * a + math.sqrt(1 - c * c) * b
    best = None
    for parts, scale in ((1, 1.5), (1, 2.0), (2, 1.25), *((k, 1.0) for k in range(3, 11))):
        if parts > 1 and 8 * parts > size:
            break
        trial = Design(2, parts, scale, probes)
        p = meet(cells(a, trial), cells(near, trial)).mean()
        if p < 0.01:
            break
        tables = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        # of unrelated vectors, the share with the same lattice point; probes add twice their number at most
        one = np.unique(cells(a, Design(1, 1, scale, 0)), return_counts=True)[1]
        same = max((one * (one - 1)).sum() / (len(a) * (len(a) - 1)), 1e-6)
        cost = tables * ((1 + probes) * ROW + n * same**parts * (1 + 2 * probes))
        if best is None or cost < best[0]:
            best = cost, Design(tables, parts, scale, probes)
    return best[1] if best else Design(1, 1, 2.0, probes)


def unit_of(data: pd.Series, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # the squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_met(a: np.ndarray, b: np.ndarray, table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Of pairs met in a table's cell: whether they don't meet in an earlier table, or in a smaller cell of this one.

    a, b: n x tables x (1 + probes) codes. A pair meets in the home of one if the other has or probes it.
    """
    one = (b == a[:, :, :1]).any(2)
    two = (a == b[:, :, :1]).any(2)
    first = meet(a, b).argmax(1)
    rows = np.arange(len(table))
    big = np.iinfo(np.int64).max
    least = np.minimum(np.where(one[rows, table], a[rows, table, 0], big), np.where(two[rows, table], b[rows, table, 0], big))
    return (first == table) & (least == cell)


def links(classes: DataFrame, threshold: float, designs: dict[int, Design], chunk: int = 512) -> DataFrame:
    """(id, other, n): links found among distinct vectors. Rows with other null give how many
    vectors (n) id is linked with; rows with other join the components.

    classes: id, many (its copies), data (bytes of the components), kind (their type), size; designs by size.
    A cell with over ``chunk`` vectors is cut into chunks whose pairs are compared apart.
    """

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (kind, size), part in pdf.groupby(["kind", "size"]):
                code = cells(unit_of(part["data"], kind), designs[size])
                tables, n = code.shape[1:]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), tables * n), "size": size, "table": np.tile(np.repeat(np.arange(tables, dtype=np.int32), n), len(part)), "cell": code.ravel(), "home": np.tile(np.arange(n) == 0, tables * len(part))})

    where = ["size", "table", "cell"]
    rows = settled(classes.select("id", "data", "kind", "size").mapInPandas(met, "id long, size int, table int, cell long, home boolean"), "cells")
    live = rows.groupBy(*where).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    live = settled(live.withColumn("chunks", F.expr(f"cast(ceil(n / {chunk}) as int)")).drop("n", "homes"), "live")
    parts = max(128, rows.count() // 16000)
    there = rows.join(live, where).withColumn("i", F.expr("cast(pmod(xxhash64(id, cell), chunks) as int)")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    there = there.select("id", *where, "home", "i", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"))
    there = there.join(classes.select("id", "many", "data", "kind"), "id").withColumn("part", F.expr(f"cast(pmod(xxhash64(size, table, cell, low, high), {parts}) as int)"))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (kind, size), group in pdf.groupby(["kind", "size"]):
            group = group.reset_index(drop=True)
            ids, row = np.unique(group["id"], return_inverse=True)
            one = group.iloc[np.unique(row, return_index=True)[1]]
            unit, many, found = unit_of(one["data"], kind), one["many"].to_numpy(), []
            for (t, cell, low, high), g in group.groupby(["table", "cell", "low", "high"]).indices.items():
                at, home, i = row[g], group["home"].to_numpy()[g], group["i"].to_numpy()[g]
                near = np.triu(unit[at] @ unit[at].T >= threshold, 1) & (home[:, None] | home[None, :])
                if low != high:
                    near &= i[:, None] != i[None, :]
                x, y = np.nonzero(near)
                if len(x):
                    found.append((at[x], at[y], np.full(len(x), t), np.full(len(x), cell)))
            if found:
                x, y, t, cell = map(np.concatenate, zip(*found))
                linked, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                code = cells(unit[linked], designs[size])
                new = first_met(code[place[: len(x)]], code[place[len(x) :]], t, cell)
                x, y = x[new], y[new]
                n = np.bincount(x, many[y], len(ids)) + np.bincount(y, many[x], len(ids))
                own = np.flatnonzero(n)
                out.append(pd.DataFrame({"id": ids[own], "other": None, "n": n[own].astype(np.int64)}))
                a, b = forest(ids[x], ids[y])
                out.append(pd.DataFrame({"id": a, "other": b, "n": 0}))
        return pd.concat(out).astype({"other": "Int64"}) if out else pd.DataFrame(columns=["id", "other", "n"])

    return there.groupBy("part").applyInPandas(compared, "id long, other long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    A row links with all others of cosine >= threshold that the tables bring together. Vectors that
    are null, empty or zero, or hold a null or non-finite component, link with nothing; vectors of
    unlike sizes don't link; a row without vec_id links with nothing and has no component. Equal
    vectors are one class, compared once and counted as often as they stand there; repeated rows
    are vectors of their own, and a tie at the threshold is a link. Very long vectors count whole.
    Other columns are left out and may have any names. An empty table gives an empty one.
    """
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", (F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).alias("_good"))
    alike = rows.where("_good").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"))

    @F.pandas_udf("binary")
    def data(x: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, kind).tobytes() for v in x])

    alike = settled(alike.withColumns({"data": data("embedding"), "kind": F.lit(kind), "size": F.size("embedding")}), "classes")
    sizes = alike.groupBy("size").count().collect()  # as many rows as there are sizes of vectors
    designs = {r["size"]: design(r["count"], r["size"], threshold, recall) for r in sizes}
    found = settled(links(alike.drop("embedding"), threshold, designs), "links")
    number = found.where("other is null").groupBy("id").agg(F.sum("n").alias("_n"))
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = alike.select("embedding", "id", "many").join(number, "id", "left").join(joined, "id", "left")
    known = settled(known.select("embedding", (F.coalesce("_n", F.lit(0)) + F.col("many") - 1).alias("_n"), F.coalesce("component", "id").alias("_c")), "known")
    out = rows.where("_good").join(known, "embedding").select("vec_id", "_n", "_c").unionByName(rows.where("not _good").select("vec_id", F.lit(0).cast("long").alias("_n"), F.col("vec_id").alias("_c")))
    return out.select("vec_id", F.col("_n").alias("n_links"), F.col("_c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("_c"), F.lit(False)).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
