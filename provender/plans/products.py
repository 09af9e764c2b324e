"""The catalogue in use: loading, search, facts, baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions.display import ingredient_sources, quantity_label, resolve_source, suggestion, summary
from provender.functions.nutrition import NAMES, UNITS, daily_pct, freshness, long_form, pct_label, precision15, progress, reference_of, reference_status, unit_of
from provender.functions.text import finite, non_negative
from provender.operators.classify import search_state
from provender.operators.joins import search_batch, search_counts
from provender.operators.ordered import ledger, product_key
from provender.operators.validate import load_validate
from provender.sources.shared import computed

SEARCHED = ["name", "brand", "manufacturer", "barcode", "traceabilityCode"]


def load_products(rows: DataFrame) -> DataFrame:
    return load_validate(rows)[0]


def search(products: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, _pos, ..., summary, suggestion) of queries (query_id, text), and each query's state."""
    hits = search_batch(products, queries, SEARCHED)
    hits = hits.withColumns({"summary": summary(*(F.col(c) for c in SEARCHED[1:])), "suggestion": suggestion(F.col("brand"), F.col("barcode"))})
    n = search_counts(products, queries, SEARCHED, "_pos")
    states = queries.join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return hits, states.select("query_id", "n", search_state(F.col("text"), F.col("n")).alias("state"))


def product_facts(products: DataFrame, as_of: Column) -> DataFrame:
    """A row for each product and nutrient: amount, share of the daily reference, and the freshness of its source."""
    flat = products.select(*long_form("nutrition", "_pos", "id", "name", "sources", "nutritionSource", "ingredients" if "ingredients" in products.columns else "id"))
    flat = flat.withColumns({"source": resolve_source(F.col("sources"), F.col("nutritionSource")), "pct": daily_pct(F.col("value"), F.col("unit"), reference_of(F.col("nutrient")), unit_of(F.col("nutrient")))})
    return flat.withColumns({"label": quantity_label(F.col("value"), F.col("unit")), "pct_label": pct_label(F.col("pct")), "progress": progress(F.col("pct")), "freshness": freshness(F.col("source.verified_at"), as_of)}).drop("sources")


def sources_of_ingredients(products: DataFrame) -> DataFrame:
    return products.select("_pos", "id", ingredient_sources(F.col("ingredients"), F.col("sources")).alias("ingredient_sources"))


def scaled_parts(x: Column) -> tuple[Column, Column, Column]:
    """A number of at least 0 as (hi * 2 ** 33 + lo) * 2 ** (32 * scale - 53), in whole numbers and without rounding."""
    scale = F.when(x > 0, F.floor(F.log2(x) / 32)).otherwise(0).cast("int")
    half = F.pow(F.lit(2.0), F.lit(-16) * scale)  # twice, as the whole factor can be too large
    unit = x * half * half * 2.0**20
    hi = F.floor(unit)
    return scale, hi, F.floor((unit - hi.cast("double")) * 2.0**33)


def totals(items: DataFrame, products: DataFrame, user: str = "user", names: list[str] = NAMES) -> DataFrame:
    """(user, nutrient, value, unit): each nutrient's sum over a basket, if every item has a valid amount of it.

    items: user, product_id, quantity. products: product_id and nutrition, a struct of {value, unit} by
    name, one row for each product at most. An item of an unknown product leaves no nutrient at all.

    Amounts are added as whole numbers, those of about the same size together, and only what comes out is
    rounded, so a sum has the same bits however rows are dealt. A basket with very many items is added where they lie.
    """
    amounts = products.select("product_id", *(F.struct(F.col("nutrition")[n]["value"].cast("double").alias("value"), F.col("nutrition")[n]["unit"].alias("unit")).alias(f"_n{i}") for i, n in enumerate(names)))
    rows = items.select(user, "product_id", F.col("quantity").cast("double").alias("_q")).join(amounts, "product_id", "left")
    columns = []
    for i, n in enumerate(names):
        a, x = F.col(f"_n{i}"), F.col(f"_n{i}")["value"] * F.col("_q")
        good = F.coalesce(finite(F.col("_q")) & (F.col("_q") > 0) & non_negative(a["value"]) & (a["unit"] == UNITS[n]) & finite(x), F.lit(False))
        columns.append(F.when(good, x).alias(f"_x{i}"))  # null: not valid
    rows = computed(rows.select(user, *columns))
    # one row an item, its amounts side by side: by scale in three whole numbers of 29 bits, 2 ** 34 of which can be added
    parts = [scaled_parts(F.coalesce(f"_x{i}", F.lit(0.0))) for i in range(len(names))]
    rows = rows.select(user, *(F.col(f"_x{i}").isNotNull().alias(f"_g{i}") for i in range(len(names))), *(F.struct(scale.cast("tinyint").alias("s"), hi.alias("hi"), lo.alias("lo")).alias(f"_p{i}") for i, (scale, hi, lo) in enumerate(parts)))
    rows = computed(rows)
    limbs = lambda p: (F.shiftright(p["hi"], 25), F.shiftleft(p["hi"].bitwiseAND(2**25 - 1), 4).bitwiseOR(F.shiftright(p["lo"], 29)), p["lo"].bitwiseAND(2**29 - 1))
    added = [F.sum(limb).alias(f"_l{i}_{j}") for i in range(len(names)) for j, limb in enumerate(limbs(F.col(f"_p{i}")))]
    wide = rows.groupBy(user, F.array(*(F.col(f"_p{i}")["s"] for i in range(len(names)))).alias("_scales")).agg(*added, *(F.bool_and(f"_g{i}").alias(f"_g{i}") for i in range(len(names))))
    # a user has few rows now, one for each set of scales; dealt by user, they become rows of a nutrient without another exchange
    each = F.array(*(F.struct(F.lit(n).alias("nutrient"), F.lit(UNITS[n]).alias("unit"), F.get("_scales", F.lit(i)).cast("int").alias("_scale"), *(F.col(f"_l{i}_{j}").cast("decimal(20,0)").alias(f"_l{j}") for j in range(3)), F.col(f"_g{i}").alias("_good")) for i, n in enumerate(names)))
    flat = wide.repartition(F.col(user)).select(user, F.inline(each))
    sums = flat.groupBy(user, "nutrient", "unit", "_scale").agg(*(F.sum(f"_l{j}").cast("decimal(20,0)").alias(f"_l{j}") for j in range(3)), F.bool_and("_good").alias("_good"))
    half = F.pow(F.lit(2.0), F.lit(16) * F.col("_scale"))
    whole = F.expr("cast(_l0 as decimal(20,0)) * cast(288230376151711744 as decimal(18,0)) + cast(_l1 as decimal(20,0)) * cast(536870912 as decimal(9,0)) + _l2").cast("double") * 2.0**-53 * half * half
    out = sums.groupBy(user, "nutrient", "unit").agg(F.array_sort(F.collect_list(F.struct("_scale", whole.alias("x")))).alias("_all"), F.bool_and("_good").alias("_good"))
    value = F.aggregate("_all", F.lit(0.0), lambda a, e: a + e["x"])  # the small ones first; there are at most 67
    return out.where("_good").withColumn("value", value).where(finite(F.col("value"))).select(user, "nutrient", precision15("value").alias("value"), "unit")


def basket_totals(items: DataFrame, products: DataFrame, user: str = "user") -> DataFrame:
    """Totals of baskets with their share of the daily reference and its status."""
    out = totals(items, products.select(F.col("id").alias("product_id"), "nutrition"), user)
    pct = daily_pct(F.col("value"), F.col("unit"), reference_of(F.col("nutrient")), unit_of(F.col("nutrient")))
    return out.withColumn("pct", pct).withColumns({"pct_label": pct_label(F.col("pct")), "status": reference_status(F.col("pct"))})


def basket_state(events: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Baskets after events; products that aren't known can't be added."""
    if products is not None:
        known = products.select(product_key(F.col("id")).alias("_known")).where("_known is not null").distinct()
        adds = events.where("op = 'add'").withColumn("_known", product_key(F.col("product_id"))).join(known, "_known", "left_semi")
        events = events.where("op <> 'add'").unionByName(adds.select(*events.columns))
    return ledger(events)
