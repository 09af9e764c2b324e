"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token has a sparse random index vector derived from its hash; a token's word vector is the
sum of the index vectors of the tokens around it. A document is the mean of its tokens' vectors;
two dense layers turn that into a logit, and a temperature fitted on rows kept aside from the
training makes probabilities of the logits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table

#: A token is a run of letters and digits, or a run of other signs.
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Rows to fit on at most; the rows with the smallest hashes of their ids are taken.
SAMPLE = 4000
CELLS, DIM, SEEDS, NEAR, HIDDEN = 1 << 14, 64, 4, 2, 24
#: Tokens whose pairs are counted at once in fitting: 8 pairs of 8 bytes each.
BLOCK = 1 << 18
#: So many tokens of the average document are added to each, which keeps short texts from extremes.
PRIOR = 20


def form(token: str) -> str:
    """The kind of a token, itself a token: invented words still say something by it."""
    if token[0].isalpha():
        return "<AA>" if len(token) > 1 and token.isupper() else "<aa>"
    return "<9>" if token[0].isalnum() else "<sign>"


def tokens(text: str) -> list[str]:
    """The tokens of a text, each followed by its form, or by <same> if it repeats the one before."""
    words = TOKEN.findall(text)
    return [x for last, w in zip(["", *words], words) for x in (w, "<same>" if w == last else form(w))]


def counted(text: str) -> Counter:
    """How often each of tokens(text) stands there."""
    words = TOKEN.findall(text)
    count = Counter(words)
    same = Counter(w for w, twice in zip(words, map(eq, words, words[1:])) if twice)
    forms: Counter = Counter()
    for w, n in count.items():
        forms[form(w)] += n - same.get(w, 0)
    forms["<same>"] += same.total()
    return count + forms


class Cells(dict):
    """The cell of a token in the table of word vectors."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        c = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) % CELLS
        return c


def index_vectors(seed: int = 7) -> np.ndarray:
    """CELLS sparse ternary vectors: SEEDS places hold +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((CELLS, DIM), np.float32)
    at = rng.integers(0, DIM, (CELLS, SEEDS))
    np.put_along_axis(out, at, rng.choice([-1.0, 1.0], (CELLS, SEEDS)).astype(np.float32), 1)
    return out


@dataclass
class Model:
    """vectors: a word vector for each cell. prior: the average document. mean, scale: of the pooled vectors. w1..b2: the layers."""

    vectors: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, text: str, cells: Cells) -> np.ndarray:
        count = counted(text)
        if not count:
            return self.prior
        at, n = np.fromiter(map(cells.__getitem__, count), np.int64, len(count)), np.fromiter(count.values(), np.float32, len(count))
        return (n @ self.vectors[at] + PRIOR * self.prior) / (n.sum() + PRIOR)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str], cells: Cells) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return sigmoid(self.logits(np.array([self.pooled(t, cells) for t in texts], np.float64)) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_vectors(texts: list[str], cells: Cells) -> np.ndarray:
    """Sum, over all places of a token in all texts, the index vectors of the tokens within NEAR words.

    Sums are added up after every some BLOCK tokens, so memory doesn't grow with the texts.
    """
    index, out, pairs, held = index_vectors(), np.zeros((CELLS, DIM), np.float64), [], 0

    def add() -> None:
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        for i in range(0, len(pair), 1 << 18):
            to, near = np.divmod(pair[i : i + (1 << 18)], CELLS)
            first = np.flatnonzero(np.diff(to, prepend=-1))
            out[to[first]] += np.add.reduceat(index[near] * n[i : i + (1 << 18), None], first)
        pairs.clear()

    for text in texts:
        whole = np.fromiter(map(cells.__getitem__, tokens(text)), np.int64)
        for start in range(0, len(whole), BLOCK):  # a pair is counted in the block of its second token
            at = whole[max(0, start - 2 * NEAR) : start + BLOCK]
            skip = start - max(0, start - 2 * NEAR)
            for k in range(1, 2 * NEAR + 1):
                one, two = at[max(0, skip - k) : len(at) - k], at[max(skip, k) :]
                pairs += (two * CELLS + one, one * CELLS + two)
            held += len(at)
            if held >= BLOCK:
                add()
                held = 0
    if pairs:
        add()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    # a token's own index vector takes part, so that tokens never met in fitting still have a vector
    return (np.divide(out, norm, where=norm > 0, out=np.zeros_like(out)) + index / np.sqrt(SEEDS)).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, epochs: int = 50, seed: int = 11) -> Model:
    """Train on four fifths of the texts with Adam, then fit the temperature on the other fifth; copies of a text are on one side."""
    cells = Cells()
    if not texts:
        texts, labels = [""], np.ones(1)
    model = Model(word_vectors(texts, cells), np.zeros(DIM), np.zeros(DIM), np.ones(DIM), np.zeros((DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    model.prior = np.mean([model.pooled(t, cells) for t in texts], 0)
    x, y = np.array([model.pooled(t, cells) for t in texts], np.float64), labels.astype(np.float64)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    aside = np.array([len(y) >= 20 and xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"), 1) % 5 == 4 for t in texts])
    aside &= not aside.all()
    xs, ys, rng = (x[~aside] - model.mean) / model.scale, y[~aside], np.random.default_rng(seed)
    p = [rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    share = np.clip(ys.mean(), 0.02, 0.98)
    weight = np.sqrt(np.where(ys == 1, 0.5 / share, 0.5 / (1 - share)))
    for _ in range(epochs):
        order = rng.permutation(len(ys))
        for i in range(0, len(ys), 128):
            b = order[i : i + 128]
            h = np.tanh(xs[b] @ p[0] + p[1])
            d = (sigmoid(h @ p[2] + p[3][0]) - ys[b]) * weight[b] / len(b)
            dh = np.outer(d, p[2]) * (1 - h * h)
            t += 1
            for k, g in enumerate((xs[b].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    if aside.any():
        z, ya = model.logits(x[aside]), y[aside]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        loss = [-np.mean(ya * np.log(q := np.clip(sigmoid(z / g), 1e-9, 1 - 1e-9)) + (1 - ya) * np.log(1 - q)) for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, of both labels alike.

    They are those with the smallest hashes of their ids, so which are taken hangs neither on order nor
    on how rows are dealt; whole texts of no more than ``sample`` documents come to the driver. A
    document with several labels counts as good if one says so; of rows that share an id the largest
    text is taken; null texts count as empty; without labelled rows the model says 0.5 or more of all.
    """
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    known = F.broadcast(settled(known, "sample"))  # ``sample`` rows of two numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    got = rows.toPandas().sort_values("text", key=lambda s: s.map(lambda t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"))), kind="stable")
    return fit(got["text"].tolist(), got["quality"].to_numpy())


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1; higher: better) to docs, from whole texts, very long ones too; null counts as empty.

    An empty text scores as the average document. Repeated rows and ties score alike; an empty table
    stays empty; a ``score`` column that docs already has is replaced, others stay whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x DIM floats: 4 MB whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cells = Cells()
        for texts in batches:
            yield pd.Series(model.value.scores(["" if t is None else t for t in texts], cells))

    return docs.drop("score").withColumn("score", score("text"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    scored = classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
