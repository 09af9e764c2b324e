"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent and the results are normalised; the
exponent is bisected until the weights' entropy meets a target, or until no source is repeated
more often than a limit allows. The weights become budgets of tokens, and each source's budget is
drawn from a permutation of its documents, taken block by block and over again if need be.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table, unwrapped, wrapped

#: In the mix of the query no document is dropped, and the rarest source is taken this many times: of a
#: source with a third of all tokens beside twenty even ones, the weight falls from 0.33 to 0.21.
REPEATS, SEED, BLOCK = 2.0, 17, 1000


def tokens_in(text: Column) -> Column:
    """The words of a text: runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, rounds: int = 10) -> float:
    """The exponent between 0 (equal weights) and 1 (shares as they are) for the shares of sources (tokens).

    entropy: the share of the largest possible entropy that the weights should have; repeats: how
    often the rarest source may be taken for each time that the most common one is. Each round
    narrows the interval sixteenfold, four bisections, by one aggregate over the sources.
    """
    total, most, least, n = sources.where("tokens > 0").agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    low, high = 0.0, 1.0
    if not n or n == 1 or most == least:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    for _ in range(rounds):
        grid = [low + (high - low) * i / 16 for i in range(17)]
        if repeats is not None:  # a source of share p is taken p ** (x - 1) times, up to a factor
            met = [(least / most) ** (x - 1) <= repeats for x in grid]  # from some exponent on
            i = met.index(True) if True in met else 16
            low, high = grid[max(0, i - 1)], grid[i]
        else:
            sums = sources.where("tokens > 0").agg(*(F.struct(F.sum(F.pow(p, F.lit(x))), F.sum(F.pow(p, F.lit(x)) * F.log(p) * x)) for x in grid)).first()
            met = [math.log(a) - b / a >= (entropy or 0) * math.log(n) for a, b in sums]  # up to some exponent
            i = met.index(False) if False in met else 16
            low, high = grid[max(0, i - 1)], grid[i]
            if i == 16 and met[16]:
                return high
    return high if repeats is not None else low


def budgets(sources: DataFrame, x: float, budget: int | None = None) -> DataFrame:
    """sources (tokens, ...) with ``weight``, ``whole`` (how often all is taken) and ``rest`` (tokens of one more round).

    Without a budget it is the least that drops nothing: the source taken least is taken once. A
    source without tokens is taken once as it is, with weight 0.
    """
    power = F.pow(F.col("tokens").cast("double"), F.lit(x))
    total, ratio = sources.where("tokens > 0").agg(F.sum(power), F.min(power / F.col("tokens"))).first()
    scale = budget / total if budget is not None and total else 1 / ratio if ratio else 0.0  # tokens taken for each unit of power
    times = F.when(F.col("tokens") > 0, power * F.lit(scale) / F.col("tokens")).otherwise(1.0)
    whole = F.floor(times + 1e-9)
    return sources.withColumns({"weight": F.when(F.col("tokens") > 0, power / F.lit(total or 1.0)).otherwise(0.0), "whole": whole.cast("int"), "rest": F.greatest(F.lit(0.0), (times - whole) * F.col("tokens"))})


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: int | None = None, source: str = "source", seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs with ``epoch``, ``block``, ``place``, ``weight`` and ``n_tokens``, each row as often as the mix takes it.

    The order of a source is (epoch, block, place): each epoch is a permutation of its documents,
    dealt into blocks by hash; the last epoch of a source ends in the block where its budget does,
    with the document that reaches it. Only blocks' sums and that one block are put in order, so a
    large source isn't gathered. Documents that tie in their place go by doc_id (null first) and text;
    repeated rows are documents of their own that share a place. A null source is a source of its own;
    null and empty texts have no tokens, and a source without any is taken once as it is; very long
    texts count whole; an empty table gives an empty one. Columns of those five names are replaced,
    others stay whatever their names.
    """
    own = F.col("_in")
    name = own.getField(source)
    rows = wrapped(docs).withColumns({"_s": F.coalesce(name.cast("string"), F.lit("")), "_none": name.isNull(), "_id": own["doc_id"], "_text": own["text"], "n_tokens": tokens_in(own["text"])})
    sources = settled(rows.groupBy("_s", "_none").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    plan = budgets(sources, exponent(sources, entropy, repeats), budget).withColumn("blocks", F.ceil(F.col("docs") / block)).drop("docs", "tokens")
    plan = settled(plan, "plan")
    dealt = rows.join(plan, ["_s", "_none"])

    def block_in(epoch: str) -> Column:
        return F.expr(f"pmod(xxhash64(_id, {epoch}, {seed}), blocks)")

    def place_in(epoch: str) -> Column:
        return F.expr(f"xxhash64(_id, {epoch}, {seed + 1})")

    last = dealt.where("rest > 0").withColumn("block", block_in("whole"))
    sums = last.groupBy("_s", "_none", "block", "rest").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_s", "_none").orderBy("block")) - F.col("n")
    cut = sums.withColumn("before", before).where("before < rest and before + n >= rest")
    # where rounding leaves the rest a little over the sum, the last block is the one
    cut = settled(cut.groupBy("_s", "_none").agg(F.min("block").alias("cut"), F.min_by("before", "block").alias("before")), "cut")
    dealt = dealt.join(cut, ["_s", "_none"], "left")
    none = F.array().cast("array<int>")
    epochs = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(none)
    more = F.when((F.col("rest") > 0) & (block_in("whole") < F.coalesce("cut", F.col("blocks"))), F.array("whole")).otherwise(none)
    taken = dealt.withColumn("epoch", F.explode(F.concat(epochs, more))).withColumns({"block": block_in("epoch"), "place": place_in("epoch")})
    edge = dealt.where((F.col("rest") > 0) & (block_in("whole") == F.col("cut"))).withColumns({"epoch": F.col("whole"), "block": block_in("whole"), "place": place_in("whole")})
    order = Window.partitionBy("_s", "_none").orderBy("place", "_id", "_text").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_before", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens")).where("_before < rest")
    added = ["epoch", "block", "place", "weight", "n_tokens"]
    both = taken.select("_in", *added).union(edge.select("_in", *added))
    return unwrapped(both, docs, **{c: c for c in added})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source: no source is taken less than once."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "block", "place", "weight", "n_tokens")
