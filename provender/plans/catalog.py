"""A catalogue of brands and products from fetched pages; retail candidates for its products; one promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions.ingredients import split_lenient
from provender.functions.keys import case_folded, name_key, product_id, sequence_ratio, source_id
from provender.functions.nutrition import NAMES, NUTRITION_TYPE, complete_non_negative, label_nutrition, serving_text
from provender.functions.pages import anchor_keys_of, brand_cards_of, brand_page_of, json_ld_keys_of, product_heading_of, shop_record_of, sitemap_links_of
from provender.functions.text import clean, filled
from provender.functions.urls import absolute_url, unquoted
from provender.operators.joins import contained, lookup_ids
from provender.operators.ordered import appended, first_wins, merge_brands, merge_index, ranked_candidates
from provender.operators.schema import product_schema, schema_validate
from provender.operators.validate import retail_gate, select_unique
from provender.sources.io import ContractError
from provender.sources.shared import computed, kept, spread


def brand_index(lists: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(_pos, name, url, category) of brands on list pages and then on site maps (url, html), one for each address."""
    parts = []
    for order, (pages, extract) in enumerate(((lists, brand_cards_of), (sitemaps, sitemap_links_of))):
        flat = pages.select(F.col("url").alias("base"), F.posexplode(extract("html")).alias("at", "b"))
        parts.append(flat.select(F.struct(F.lit(order).alias("o"), "base", "at").alias("_o"), F.col("b.name").alias("name"), absolute_url(F.col("b.href"), F.col("base")).alias("url"), F.col("b.category").alias("category")))
    rows = reduce(DataFrame.unionByName, parts).withColumn("_key", case_folded(unquoted("url")))
    merged = merge_index(rows, F.col("_key"), order="_o")
    return merged.select(F.col("_o").alias("_pos"), "name", "url", "category")


def brand_pages(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Brands of the index with ``_b``, what their pages (url, html) say, ``_name``, and ``error``, why nothing is known of one."""
    found = index.join(pages.select("url", "html"), "url", "left").withColumn("_b", brand_page_of("html"))
    found = found.withColumn("_name", F.when(F.col("_b.name") != "", F.col("_b.name")).otherwise(F.col("name")))
    return found.withColumn("error", F.when(F.col("html").isNull(), "page missing").when(F.col("_b.name").isNull(), "no introduction").when(F.coalesce("_name", F.lit("")) == "", "no name")).drop("html")


def brands(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Brands of the index with what their pages (url, html) say, merged by name; brands whose page is missing or says nothing go."""
    found = brand_pages(index, pages).where("error is null")
    products = found.select("_pos", "url", F.posexplode("_b.products").alias("at", "p"))
    image = absolute_url(F.col("p.src"), F.col("url"))
    products = products.withColumn("image", F.when((F.col("p.src") != "") & image.rlike(r"\Ahttps?:"), image).otherwise(""))
    products = products.groupBy("_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("p.name").alias("name"), "image"))), lambda x: F.struct(x["name"].alias("name"), x["image"].alias("image_url"))).alias("products"))
    links = found.select("_pos", "url", F.posexplode("_b.links").alias("at", "l")).withColumn("to", absolute_url(F.col("l.href"), F.col("url"))).where(F.col("to").rlike(r"\Ahttps?:"))
    links = first_wins(links, [F.col("_pos"), F.col("to")], "at")
    links = links.groupBy("_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("l.name").alias("name"), "to"))), lambda x: F.struct(x["name"].alias("name"), x["to"].alias("url"))).alias("external_links"))
    out = found.select("_pos", F.col("_name").alias("name"), "url", "category", F.col("_b.description").alias("description")).join(products, "_pos", "left").join(links, "_pos", "left")
    none = lambda c, k: F.coalesce(c, F.array().cast(f"array<struct<name:string,{k}:string>>"))
    return merge_brands(out.withColumns({"products": none("products", "image_url"), "external_links": none("external_links", "url")}))


def catalog_errors(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, url, error) of brands of which nothing is known, in the order of the index."""
    return brand_pages(index, pages).where("error is not null").orderBy("_pos").select("name", "url", "error")


def catalog_stats(index: DataFrame, merged: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: brands listed, brands after merging, products, brands whose page was read, and those whose page failed."""
    read = brand_pages(index, pages).agg(F.count("*").alias("brands_listed"), F.count_if(F.col("error").isNull()).alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    own = merged.agg(F.count("*").alias("brands"), F.coalesce(F.sum(F.size("products")), F.lit(0)).alias("products"))
    return read.join(F.broadcast(own)).select("brands_listed", "brands", "products", "fetched", "failed")  # one row each


CANDIDATE = ["target_id", "source_name", "source_url", "matched_name", "barcode", "specification", "serving", "nutrition", "ingredients", "match_score"]


def from_catalogue(targets: DataFrame, pages: DataFrame, details: DataFrame, source: str) -> DataFrame:
    """Candidates of the catalogue itself: a target's product on its page, by the listed id, and that id's details (product_id, html)."""
    # pages of lists grow with the catalogue: dealt out, few of them meet in one worker
    listed = spread(pages.select(F.col("url").alias("page"), "html")).select("page", F.posexplode(anchor_keys_of("html")).alias("_pos", "a")).select("page", "_pos", F.col("a.product_id").alias("product_id"), F.col("a.key").alias("key"))
    wanted = targets.select("target_id", "product_name", F.col("catalog_source").alias("page"), name_key("product_name").alias("key"))
    # details are far larger than Spark takes them for, and so aren't sent to all; those that are wanted are read, once
    rows = computed(lookup_ids(wanted, listed).join(details.hint("merge"), "product_id").withColumn("_h", product_heading_of("html")).drop("html")).where("_h.name <> ''")
    return rows.select(
        "target_id", F.lit(source).alias("source_name"), F.col("page").alias("source_url"), F.col("_h.name").alias("matched_name"), F.lit(None).cast("string").alias("barcode"), F.when(F.col("_h.serving") != "", F.col("_h.serving")).alias("specification"),
        serving_text(F.col("_h.serving")).alias("serving"), F.lit(None).cast(NUTRITION_TYPE).alias("nutrition"), F.array().cast("array<string>").alias("ingredients"), sequence_ratio("product_name", F.col("_h.name")).alias("match_score"),
    )


def from_shop(targets: DataFrame, searches: DataFrame, pages: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of a shop, and errors (target_id, source_name, error).

    searches (target_id, html): the result page of each target's query; pages (url, html): product pages.
    """
    # pages of results are quick to read and slow to work on
    found = spread(searches.select("target_id", "html")).select("target_id", F.posexplode(json_ld_keys_of("html")).alias("_pos", "p")).select("target_id", "_pos", F.col("p.name").alias("found_name"), F.col("p.url").alias("url"), F.col("p.key").alias("name_key"))
    keys = targets.select("target_id", name_key("brand").alias("brand_key"), name_key("product_name").alias("product_key"))
    # no side is sent to all: each grows with the targets, and pages are far larger than Spark takes them for. Targets come before
    # pages, as hits lie by target already and are still short
    hits = contained(keys, found).join(targets.select("target_id", F.concat("brand", "product_name").alias("query")).hint("merge"), "target_id")
    hits = hits.join(pages.select("url", "html").hint("merge"), "url", "left").withColumn("_r", shop_record_of("html"))
    missing = F.col("_r.name").isNull() & F.col("_r.barcode").isNull() & F.col("_r.specification").isNull() & F.col("_r.details").isNull()
    read = F.when(F.col("html").isNull(), "page missing").when(missing, "record not found")
    # of rows with the same label the last counts, in the place of the first
    block = lambda test: F.coalesce(F.get(F.filter("_r.rows", test), F.lit(0))["text"], F.lit(""))
    texts = {"_i": block(lambda r: F.contains(r["label"], F.lit("內容物")) & F.contains(r["label"], F.lit("成分"))), "_l": block(lambda r: F.contains(r["label"], F.lit("營養標示")))}
    own = ["target_id", "_pos", "url", "found_name", "query", F.col("_r.name").alias("_name"), F.col("_r.barcode").alias("_barcode"), F.col("_r.specification").alias("_specification")]
    rows = computed(hits.select(*own, read.alias("_read"), *(c.alias(n) for n, c in texts.items()))).withColumn("_n", label_nutrition(F.col("_l"))).drop("_l")
    # candidates and errors are read from these, and once more for ranks: pages are gone through once
    rows = kept(rows, "shop").withColumn("error", F.coalesce("_read", "_n.error"))
    # an error makes the whole source fail for the target
    failed = rows.where("error is not null").groupBy("target_id").agg(F.min_by("error", "_pos").alias("error"))
    good = rows.join(failed.select("target_id").hint("merge"), "target_id", "left_anti")
    name = F.trim(F.coalesce(F.when(F.col("_name") != "", F.col("_name")), F.col("found_name")))
    blank = lambda c: F.when(clean(F.col(c)) != "", clean(F.col(c)))
    out = good.withColumn("matched_name", name).select(
        "target_id", F.lit(source).alias("source_name"), F.col("url").alias("source_url"), "matched_name", blank("_barcode").alias("barcode"), blank("_specification").alias("specification"),
        F.when(F.col("_n.serving").isNotNull(), F.struct(F.col("_n.serving.amount").alias("amount"), F.col("_n.serving.unit").alias("unit"), F.lit(None).cast("string").alias("text"))).alias("serving"),
        F.col("_n.nutrition").alias("nutrition"), split_lenient("_i").alias("ingredients"), sequence_ratio("query", "matched_name").alias("match_score"), "_pos",
    )
    return out, failed.select("target_id", F.lit(source).alias("source_name"), "error")


def match_candidates(*sources: DataFrame) -> DataFrame:
    """All sources' candidates with ``rank`` within their target: the likeliest first, then in order of the sources."""
    parts = [s.select(*CANDIDATE, F.lit(i).alias("_source"), F.col("_pos") if "_pos" in s.columns else F.lit(0).alias("_pos")) for i, s in enumerate(sources)]
    return ranked_candidates(reduce(DataFrame.unionByName, parts), ["target_id"], "match_score", "_source", "_pos").drop("_source", "_pos")


def retail_product(candidates: DataFrame) -> DataFrame:
    """Retail candidates (with brand, product_name, generated_at) as formal products: ``refusal`` says why not, ``product`` is VARIANT."""
    complete = complete_non_negative(F.col("nutrition"))
    rows = candidates.withColumn("refusal", retail_gate(complete)).withColumn("_s", source_id("source_url"))
    rows = rows.withColumn("id", product_id(F.col("brand"), F.col("product_name"), clean(F.col("specification")), clean(F.col("barcode"))))
    nutrition = F.struct(*(F.struct(F.col("nutrition")[n]["value"].alias("value"), clean(F.col("nutrition")[n]["unit"]).alias("unit")).alias(n) for n in NAMES))
    product = F.struct(
        "id", clean(F.col("matched_name")).alias("name"), clean(F.col("brand")).alias("brand"), clean(F.col("barcode")).alias("barcode"), F.struct(F.col("serving.amount").alias("amount"), clean(F.col("serving.unit")).alias("unit")).alias("serving"), nutrition.alias("nutrition"),
        F.transform("ingredients", lambda i: F.struct(clean(i).alias("name"), F.col("_s").alias("sourceId"))).alias("ingredients"), F.col("_s").alias("nutritionSource"),
        F.array(F.struct(F.col("_s").alias("id"), clean(F.col("source_name")).alias("name"), clean(F.col("source_url")).alias("url"), F.substring_index("generated_at", "T", 1).alias("verified_at"))).alias("sources"),
    )
    return rows.withColumn("product", F.when(F.col("refusal").isNull(), F.try_parse_json(F.to_json(product)))).drop("_s")


def promote_one(candidates: DataFrame, existing: DataFrame, condition: Column, schema: dict | None = None) -> DataFrame:
    """The one candidate that meets a condition, as a product after the existing ones (_pos, id, barcode, product)."""
    row = retail_product(select_unique(candidates, condition))
    new = row.select(F.lit(0).cast("long").alias("_pos"), "id", clean(F.col("barcode")).alias("barcode"), "product", "refusal")
    if refusal := new.first()["refusal"]:
        raise ContractError(refusal)
    for column in ("barcode", "id"):
        if existing.where(filled(F.col(column))).join(new, column, "left_semi").limit(1).count():
            raise ContractError(f"{column} exists already")
    if schema_validate(new, "product", schema or product_schema()).where("status = 'blocked'").count():
        raise ContractError("not valid under the schema")
    return appended(existing.select("_pos", "id", "barcode", "product"), new.drop("refusal"))

