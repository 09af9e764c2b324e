"""More queries over the driver's tables: keys and labels, retail candidates, promotion, web sites, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.functions.display import ingredient_sources, ratio_label, suggestion
from provender.functions.keys import match_key, name_key, product_id, source_id
from provender.functions.nutrition import NAMES, UNITS, label_nutrition, serving_text
from provender.functions.text import plain_key, single_spaced
from provender.functions.urls import absolute_url, decode_redirect
from provender.operators.joins import contained, lookup_ids, unfinished
from provender.operators.ordered import appended, merge_brands, restored
from provender.operators.validate import catalogue_faults, refers_to_source, select_unique
from provender.query_table import query, read
from provender.sources.io import catalog_targets, first_rows
from provender.sources.shared import computed, kept, spread


@query("""
WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 11 = 0 AS odd, p_partkey % 5 = 0 AS bare FROM part)
SELECT p_partkey, CASE WHEN NOT bare THEN CAST(s AS DOUBLE) END AS amount, CASE WHEN NOT bare THEN CASE WHEN p_partkey % 2 = 0 THEN 'ml' ELSE 'g' END END AS unit,
  CASE WHEN odd THEN NULL ELSE CAST(s AS DOUBLE) + 0.5 END AS calories, CASE WHEN p_partkey % 3 = 0 THEN 7.0 ELSE CAST(s AS DOUBLE) END AS sodium, CASE WHEN p_partkey % 3 = 0 THEN 'g' ELSE 'mg' END AS sodium_unit,
  CASE WHEN odd THEN 'invalid_numeral' END AS error FROM p""")
def q_label_nutrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of labels: serving, nutrients, later lines over earlier ones, numerals that are none."""
    text = F.expr(r"""concat(if(p_partkey % 5 = 0, '營養標示', concat('每一份量 ', p_size, if(p_partkey % 2 = 0, '毫升', ' 公克'))), '\n 熱量 ', if(p_partkey % 11 = 0, '1.2.3', concat(p_size, '.5')), ' 大卡\r\n鈉', p_size, '毫克', if(p_partkey % 3 = 0, '\n鈉 7 公克', ''), '\n其他 3 公克')""")
    n = F.col("n")
    rows = computed(spread(read(spark, sf_dir, "part")).select("p_partkey", label_nutrition(text).alias("n")))
    return rows.select("p_partkey", n["serving"]["amount"].alias("amount"), n["serving"]["unit"].alias("unit"), n["nutrition"]["calories"]["value"].alias("calories"), n["nutrition"]["sodium"]["value"].alias("sodium"), n["nutrition"]["sodium"]["unit"].alias("sodium_unit"), n["error"].alias("error"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS DOUBLE) + CASE WHEN p_partkey % 4 = 1 THEN 0.25 ELSE 0 END END AS amount, CASE p_partkey % 4 WHEN 0 THEN 'ml' WHEN 1 THEN 'Gram' END AS unit,
  CASE p_partkey % 4 WHEN 0 THEN p_size || ' ml' WHEN 1 THEN ' ' || p_size || '.25Gram ' WHEN 2 THEN p_size || '公克' END AS text FROM part""")
def q_serving_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving sizes in digits and letters, and those that are anything else."""
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' ml') WHEN 1 THEN concat(' ', p_size, '.25Gram ') WHEN 2 THEN concat(p_size, '公克') ELSE '' END")
    return read(spark, sf_dir, "part").select("p_partkey", serving_text(text).alias("s")).select("p_partkey", "s.*")


@query("""
SELECT p_partkey, trim(regexp_replace(lower(concat_ws('-', p_brand, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_type END, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END)), '[^0-9a-z]+', '-', 'g'), '-') AS id,
  CASE p_partkey % 3 WHEN 0 THEN 'shop' || p_partkey WHEN 1 THEN 'a-b' || p_partkey ELSE 'localhost' END AS source_id FROM part""")
def q_product_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formal ids out of a product's parts, and source ids out of addresses."""
    k = F.col("p_partkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://www.Shop"), k, F.lit(".com.tw/x"))).when(k % 3 == 1, F.concat(F.lit("http://u@m.a_b"), k, F.lit(".org:8080/?q"))).otherwise("http://localhost/")
    spec, code = F.when(k % 3 > 0, F.col("p_type")).otherwise(""), F.when(k % 2 == 0, k.cast("string")).otherwise("")
    return read(spark, sf_dir, "part").select("p_partkey", product_id(F.col("p_brand"), F.col("p_name"), spec, code).alias("id"), source_id(url).alias("source_id"))


@query("""
SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') || '茶' AS name, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') || '12茶' AS match,
  replace(lower(p_name), ' ', '') || '茶' AS plain, '<b> ' || p_name || ' </b> 茶' AS spaced FROM part""")
def q_match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four keys that names are compared by."""
    name = F.upper("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", name_key(F.concat(name, F.lit("・茶!"))).alias("name"), match_key(F.concat(F.regexp_replace(name, " ", "%20"), F.lit("１２ 茶"))).alias("match"),
        plain_key(F.concat(F.lit("<b>"), name, F.lit(" </b>　茶"))).alias("plain"), single_spaced(F.concat(F.lit(" <b>\n "), F.col("p_name"), F.lit("　 </b>\t茶 "))).alias("spaced"),
    )


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://other.example/?uddg=x' END AS target, 'https://h' || page_id || '.example/a/x%20y%E8%8C%B6?q=a%20b&c=%41' AS absolute FROM pages""")
def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search redirects resolved, and links made absolute."""
    k = F.col("page_id")
    raw = F.when(k % 2 == 0, F.concat(F.lit("https://duckduckgo.com/l/?rut=1&amp;uddg="), F.url_encode("url"))).otherwise("https://other.example/?uddg=x")
    base = F.concat(F.lit("HTTPS://H"), k, F.lit(".Example/a/b/c"))
    return read(spark, sf_dir, "pages").select("page_id", decode_redirect(raw).alias("target"), absolute_url(F.lit(" ../x y茶?q=a b&c=%41#top "), base).alias("absolute"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '目前尚無資料' ELSE p_brand END || ' · ' || CASE WHEN p_partkey % 3 = 0 THEN '目前尚無資料' ELSE CAST(p_partkey AS VARCHAR) END AS suggestion,
  CASE p_partkey % 3 WHEN 0 THEN p_size || '%' WHEN 1 THEN p_size || '.5 mg' END AS ratio,
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'b,a' ELSE 'b' END AS sources FROM part""")
def q_product_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions, shares of ingredients, and the sources that ingredients name, in order of first use."""
    k = F.col("p_partkey")
    brand, code = F.when(k % 4 == 0, " Undefined").otherwise(F.col("p_brand")), F.when(k % 3 == 0, " ").otherwise(k.cast("string"))
    ratio = ratio_label(F.when(k % 3 == 2, -1.0).otherwise(F.col("p_size") + (k % 3) / 2), F.when(k % 3 == 0, " % ").otherwise("mg"))
    names = ("b", "c", "missing", "b", "a")
    used = F.array(*(F.struct(F.when((k % 5 == 0) | ((F.lit(s) == "a") & (k % 2 > 0)), " ").otherwise("x").alias("name"), F.lit(s).alias("sourceId")) for s in names))
    known = F.array(*(F.struct(F.lit(s).alias("id"), F.lit("n").alias("name"), F.lit(u).alias("url")) for s, u in (("a", "https://a/"), ("b", "http://b/"), ("c", "ftp://c/"))))
    found = F.array_join(F.transform(ingredient_sources(used, known), lambda s: s["id"]), ",")
    return read(spark, sf_dir, "part").select("p_partkey", suggestion(brand, code).alias("suggestion"), ratio.alias("ratio"), found.alias("sources"))


def _retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as retail candidates, a fault in some by their key."""
    k = F.col("p_partkey")

    def but(n: int, good: Column, bad: Column) -> Column:
        return F.when(k % 12 == n, bad).otherwise(good)

    nutrition = F.struct(*(F.struct(but(9, F.col("p_size").cast("double"), F.lit(-1.0)).alias("value"), F.lit(UNITS[n]).alias("unit")).alias(n) for n in NAMES))
    return read(spark, sf_dir, "part").select(
        k, but(1, F.lit("https://www.shop.com.tw/p"), F.lit(" ")).alias("source_url"), but(2, F.lit("Shop"), F.lit(None)).alias("source_name"), but(3, F.concat(F.lit(" "), "p_name"), F.lit("")).alias("matched_name"), but(4, F.col("p_brand"), F.lit("")).alias("brand"),
        but(5, k.cast("string"), F.lit("12a")).alias("barcode"), F.struct(but(6, F.lit(5.0), F.lit(float("nan"))).alias("amount"), F.lit(" g").alias("unit")).alias("serving"), nutrition.alias("nutrition"), but(7, F.array(F.lit("水"), F.lit("糖")), F.array(F.lit(" "))).alias("ingredients"),
        but(8, F.lit("2026-01-31T00:00:00Z"), F.lit("2026-02-30T00:00:00Z")).alias("generated_at"), F.col("p_name").alias("product_name"), F.col("p_type").alias("specification"),
    )


RETAIL_ID = "trim(regexp_replace(lower(p_brand || '-' || p_name || '-' || p_type || '-' || p_partkey), '[^0-9a-z]+', '-', 'g'), '-')"


@query(f"""
SELECT p_partkey, CASE p_partkey % 12 WHEN 1 THEN 'source_url missing' WHEN 2 THEN 'source_name missing' WHEN 3 THEN 'matched_name missing' WHEN 4 THEN 'brand missing' WHEN 5 THEN 'barcode not digits' WHEN 6 THEN 'serving not convertible'
  WHEN 7 THEN 'ingredient without a name' WHEN 8 THEN 'generated_at not a date' WHEN 9 THEN 'nutrition incomplete' END AS refusal,
  CASE WHEN p_partkey % 12 NOT BETWEEN 1 AND 9 THEN {RETAIL_ID} END AS id, CASE WHEN p_partkey % 12 NOT BETWEEN 1 AND 9 THEN 'shop' END AS source, CASE WHEN p_partkey % 12 NOT BETWEEN 1 AND 9 THEN CAST(p_size AS DOUBLE) END AS sodium FROM part""")
def q_retail_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail candidates as products, or the first thing that keeps them from it."""
    from provender.plans.catalog import retail_product

    rows = retail_product(_retail(spark, sf_dir)).select("p_partkey", "refusal", "product")
    at = lambda path, kind: F.try_variant_get("product", path, kind)
    return rows.select("p_partkey", "refusal", at("$.id", "string").alias("id"), at("$.sources[0].id", "string").alias("source"), at("$.nutrition.sodium.value", "double").alias("sodium"))


@query(f"SELECT p_partkey - 1 AS _pos, 'old-' || p_partkey AS id FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part), {RETAIL_ID} FROM part WHERE p_partkey = 120")
def q_promote_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retail candidate promoted after the products there are."""
    from provender.plans.catalog import promote_one

    k = F.col("p_partkey")
    old = read(spark, sf_dir, "part").select((k - 1).cast("long").alias("_pos"), F.concat(F.lit("old-"), k).alias("id"), F.concat(F.lit("9"), k).alias("barcode"), F.try_parse_json(F.concat(F.lit('{"id":"old-'), k, F.lit('","name":"n"}'))).alias("product"))
    return promote_one(_retail(spark, sf_dir), old, k == 120).select("_pos", "id")


@query("""
WITH l AS (SELECT l_orderkey % 50 AS page, p_name AS key, l_partkey AS product_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS pos FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT p_partkey AS target_id, p_partkey % 50 AS page, p_name AS key FROM part)
SELECT target_id, arg_max(product_id, pos) AS product_id FROM t JOIN l USING (page, key) GROUP BY target_id""")
def q_lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with the id that their page lists last under their name."""
    parts = read(spark, sf_dir, "part")
    listed = read(spark, sf_dir, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_orderkey") % 50).alias("page"), F.col("p_name").alias("key"), F.col("l_partkey").alias("product_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("_pos"))
    targets = parts.select(F.col("p_partkey").alias("target_id"), (F.col("p_partkey") % 50).alias("page"), F.col("p_name").alias("key"))
    return lookup_ids(targets, listed).select("target_id", "product_id")


@query("""
WITH t AS (SELECT s_suppkey AS target_id, substr(lower(n_name), 1, 1) AS b, CAST(s_suppkey % 10 AS VARCHAR) AS p FROM supplier JOIN nation ON n_nationkey = s_nationkey),
f AS (SELECT l_suppkey AS target_id, p_name || l_partkey AS name, 'u' || (l_partkey % 7) AS url, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS pos FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT target_id, url, arg_min(name, pos) AS name_key FROM f JOIN t USING (target_id) WHERE contains(name, b) AND contains(name, p) GROUP BY ALL""")
def q_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products found for a target that hold its brand and name, the first of each address."""
    targets = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("target_id"), F.substring(F.lower("n_name"), 1, 1).alias("brand_key"), (F.col("s_suppkey") % 10).cast("string").alias("product_key"))
    found = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("target_id"), F.concat("p_name", "l_partkey").alias("name_key"), F.concat(F.lit("u"), F.col("l_partkey") % 7).alias("url"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("_pos"))
    return contained(targets, found).select("target_id", "url", "name_key")


@query("""
WITH c AS (SELECT l_orderkey AS target_id, CAST(l_partkey AS VARCHAR) AS barcode, l_extendedprice AS s, l_linenumber % 2 AS src, l_linenumber AS pos FROM lineitem)
SELECT target_id, barcode, CAST(row_number() OVER (PARTITION BY target_id ORDER BY s DESC, src, pos) AS INTEGER) AS rank FROM c""")
def q_match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two sources in one order for each target."""
    from provender.plans.catalog import CANDIDATE, match_candidates

    line = F.col("l_linenumber")
    # numbers below 0 come first and missing ones last; where price and number are equal, which the SQL leaves open, the smaller part does
    order = F.struct(F.coalesce(line % 2, F.lit(2)).alias("source"), line.alias("line"), F.col("l_partkey").alias("part"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target_id"), F.col("l_partkey").cast("string").alias("barcode"), F.col("l_extendedprice").cast("double").alias("match_score"), order.alias("_pos"))
    rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CANDIDATE), "_pos")
    return match_candidates(rows.where("_pos.source < 1"), rows.where("_pos.source >= 1")).select("target_id", "barcode", "rank")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 > 0 OR s_suppkey % 3 = 0")
def q_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses whose input was not evaluated yet."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(k, F.concat(F.lit("b"), k).alias("identity"), F.md5("s_name").alias("signature"))
    done = rows.where(k % 4 == 0).select("identity", F.when(k % 3 == 0, "old").otherwise(F.col("signature")).alias("signature"))
    return unfinished(rows, done).select("s_suppkey")


@query("SELECT p_partkey, p_partkey % 3 = 1 AS refers FROM part")
def q_source_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the source of a product's nutrition is one of its sources."""
    k = F.col("p_partkey")
    sources = F.array(F.struct(F.lit("a").alias("id")), F.struct(F.lit("b").alias("id")))
    return read(spark, sf_dir, "part").select("p_partkey", refers_to_source(sources, F.when(k % 3 == 0, " ").when(k % 3 == 1, " b ").otherwise("c")).alias("refers"))


@query("""
SELECT count(*) AS records, count(*) FILTER (p_partkey % 3 > 0) AS complete_nutrition, 0 AS empty_label, count(*) FILTER (p_partkey % 13 = 0) + count(*) FILTER (p_partkey % 3 = 0) AS anomaly_items, count(*) FILTER (p_partkey % 13 = 0 OR p_partkey % 3 = 0) AS anomaly_records FROM part""")
def q_collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was collected, in one row."""
    from provender.plans.traceability import collection_stats
    from provender.queries import _trace

    return collection_stats(_trace(spark, sf_dir))


@query("""
WITH c AS (SELECT *, p_partkey - CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS code, CASE WHEN p_partkey % 13 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS pack FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0),
d AS (SELECT count(*) AS n FROM c GROUP BY code HAVING count(*) > 1), e AS (SELECT count(*) AS n FROM c GROUP BY p_brand, p_name, pack HAVING count(*) > 1)
SELECT (SELECT count(*) FROM part) AS scanned, count(*) AS selected, count(*) FILTER (p_partkey % 17 = 0) AS missing_serving, count(*) FILTER (p_partkey % 7 = 0) AS ingredient_parse_failures, 0 AS nutrition_anomalies, count(*) FILTER (p_partkey % 13 = 0) AS anomaly_rows,
  (SELECT count(*) FROM d) AS duplicate_codes, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM d) AS duplicate_code_records, (SELECT count(*) FROM e) AS duplicate_products, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM e) AS duplicate_product_records FROM c""")
def q_candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What candidates were built, in one row."""
    from provender.plans.traceability import candidate_stats
    from provender.queries import _candidates, _trace

    return candidate_stats(_trace(spark, sf_dir), _candidates(spark, sf_dir))


PICKED = "p_partkey % 3 <> 0 AND p_partkey % 5 <> 0"


@query(f"""
WITH c AS (SELECT [x FOR x IN ['missing_brand', 'missing_barcode', CASE WHEN p_partkey % 17 = 0 THEN 'missing_serving' END, CASE WHEN p_partkey % 7 = 0 THEN 'ingredients_parse_error' END] IF x IS NOT NULL] AS i FROM part WHERE {PICKED})
SELECT 'issue' AS kind, name, count(*) AS n FROM (SELECT unnest(i) AS name FROM c) GROUP BY name UNION ALL SELECT 'category', 'multiple_issues', count(*) FROM c HAVING count(*) > 0""")
def q_promotion_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and categories of candidates before promotion, counted."""
    from provender.plans.traceability import promotion_analysis
    from provender.queries import _candidates

    _, by_issue, by_category, _ = promotion_analysis(_candidates(spark, sf_dir))
    return by_issue.select(F.lit("issue").alias("kind"), F.col("issue").alias("name"), "n").union(by_category.select(F.lit("category"), "issueCategory", "n"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every nineteenth key as products there are; of every 38th one isn't valid."""
    k = F.col("p_partkey")
    name = F.when(k % 38 == 0, " ").otherwise("n")
    return spread(read(spark, sf_dir, "part").where(k % 19 == 0)).select(k.cast("long").alias("_pos"), F.concat(F.lit("old-"), k).alias("id"), F.concat(F.lit("T"), k).alias("traceabilityCode"), F.try_parse_json(F.concat(F.lit('{"id":"old-'), k, F.lit('","name":"'), name, F.lit('"}'))).alias("product"))


DRY = f"""
WITH c AS (SELECT p_partkey, p_partkey - CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS code, p_brand, p_name, CASE WHEN p_partkey % 13 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS pack, p_partkey % 17 <> 0 AND p_partkey % 7 <> 0 AS ok FROM part WHERE {PICKED}),
e AS (SELECT *, count(*) OVER (PARTITION BY code) > 1 AS dup, code IN (SELECT p_partkey FROM part WHERE p_partkey % 19 = 0) AS old FROM c WHERE ok),
g AS (SELECT count(*) AS n FROM e GROUP BY p_brand, p_name, pack HAVING count(*) > 1)"""


@query(f"""{DRY}
SELECT 'dry-run' AS mode, false AS products_modified, (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM e) AS convertible, (SELECT count(*) FROM c WHERE NOT ok) AS ineligible, (SELECT count(*) FROM c WHERE p_partkey % 17 = 0) AS invalid_serving, 0 AS incomplete_nutrition,
  (SELECT count(*) FROM c WHERE p_partkey % 7 = 0) AS ingredient_parse_failures, (SELECT count(*) FROM e) AS converted, 0 AS not_converted, (SELECT count(*) FROM e) AS schema_pass, 0 AS schema_fail, 0 AS duplicate_id_values, 0 AS duplicate_id_records,
  (SELECT count(DISTINCT code) FROM e WHERE dup) AS duplicate_code_values, (SELECT count(*) FROM e WHERE dup) AS duplicate_code_records, 0 AS existing_id_conflicts, (SELECT count(DISTINCT code) FROM e WHERE old) AS existing_code_conflicts, (SELECT count(*) FROM e WHERE old) AS existing_conflict_records,
  (SELECT count(*) FROM g) AS duplicate_product_groups, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM g) AS duplicate_product_records, 0 AS duplicate_product_records_merged, (SELECT count(*) FROM e WHERE NOT dup AND NOT old) AS safe_imports,
  CASE WHEN (SELECT min(p_partkey) FROM part WHERE p_partkey % 38 = 0) IS NULL THEN NULL ELSE '$.products[' || (SELECT min(p_partkey) FROM part WHERE p_partkey % 38 = 0) || '].name pattern' END AS batch_schema_error,
  CASE WHEN (SELECT min(p_partkey) FROM part WHERE p_partkey % 38 = 0) IS NULL THEN 'pass' ELSE 'fail' END AS batch_schema_validation""")
def q_dry_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of what promotion would do."""
    from provender.plans.traceability import dry_run
    from provender.queries import _candidates

    return dry_run(_candidates(spark, sf_dir), _catalogue(spark, sf_dir))[0]


@query(f"""{DRY}
SELECT DISTINCT 'duplicate_codes' AS kind, 'T' || code AS value FROM e WHERE dup UNION ALL SELECT DISTINCT 'existing_code_conflicts', 'T' || code FROM e WHERE old""")
def q_dry_run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the way of promotion, by kind."""
    from provender.plans.traceability import dry_run
    from provender.queries import _candidates

    return dry_run(_candidates(spark, sf_dir), _catalogue(spark, sf_dir))[1]


CLEAN = f"{PICKED} AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0"


@query(f"""
WITH old AS (SELECT p_partkey AS _pos, 'old-' || p_partkey AS id FROM part WHERE p_partkey % 19 = 0 AND p_partkey % 38 > 0)
SELECT _pos, id FROM old UNION ALL SELECT p_partkey + (SELECT max(_pos) + 1 FROM old), 'tfda-traceability:T' || p_partkey FROM part WHERE {CLEAN}""")
def q_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a conflict promoted after the products there are."""
    from provender.plans.traceability import promote
    from provender.queries import _candidates

    good = _candidates(spark, sf_dir).where(CLEAN.replace("p_partkey", "_pos"))
    return promote(good, _catalogue(spark, sf_dir).where("_pos % 38 > 0"), good.count()).select("_pos", "id")


@query("""
WITH r AS (SELECT CASE WHEN p_partkey % 20 = 0 THEN '' ELSE 'p' || (p_partkey % 150) END AS id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 't' || (p_partkey % 170) END AS code FROM part)
SELECT 'id' AS "column", id AS value, count(*) AS n FROM r GROUP BY id HAVING count(*) > 1 OR id = '' UNION ALL SELECT 'traceabilityCode', code, count(*) FROM r WHERE code <> '' GROUP BY code HAVING count(*) > 1""")
def q_catalogue_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank and repeated ids and codes of a catalogue."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.when(k % 20 == 0, " ").otherwise(F.concat(F.lit("p"), k % 150)).alias("id"), F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit(" t"), k % 170)).alias("traceabilityCode"))
    return catalogue_faults(rows)


@query("SELECT o_orderkey AS _pos, 'old' AS kind FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders WHERE o_orderkey % 2 = 0), 'new' FROM orders WHERE o_orderkey % 2 = 1")
def q_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows after those there are, positions and all."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos"))
    return appended(rows.where("_pos % 2 = 0").withColumn("kind", F.lit("old")), rows.where("_pos % 2 = 1").withColumn("kind", F.lit("new")))


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 37")
def q_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in order of their position: the operator's own limit."""
    return first_rows(read(spark, sf_dir, "customer").repartition(5), 37, "c_custkey").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)")
def q_select_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row that meets a condition."""
    parts = read(spark, sf_dir, "part")
    return select_unique(parts, F.col("p_partkey") == parts.agg(F.min("p_partkey")).first()[0]).select("p_partkey")


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, several rows of each, with the names of parts as products and containers as links."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("_pos"), F.when(k % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit("<i> "), "p_brand", F.lit("</i>"))).alias("name"), F.concat(F.lit("u"), k).alias("url"), F.when(k % 3 > 0, F.col("p_type")).otherwise("").alias("description"),
        F.array(F.struct(F.concat(F.lit("x"), k % 5).alias("name")), F.struct(F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("Y"), k % 3)).alias("name"))).alias("products"), F.array(F.struct(F.lit("l").alias("name"), F.concat(F.lit("v"), k % 4).alias("url"))).alias("external_links"),
    )


@query("""
WITH r AS (SELECT p_partkey AS p, lower(p_brand) AS b, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
i AS (SELECT b, p, n, 0 AS o, 'x' || (p % 5) AS item FROM r UNION ALL SELECT b, p, n, 1, CASE WHEN p % 4 = 0 THEN ' ' ELSE 'Y' || (p % 3) END FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY b, trim(lower(item)) ORDER BY n, o) AS m FROM i),
o AS (SELECT b, string_agg(item, '|' ORDER BY n, o) AS products FROM k WHERE n = 1 OR (m = 1 AND trim(item) <> '') GROUP BY b),
l AS (SELECT b, string_agg(v, '|' ORDER BY p) AS links FROM (SELECT b, 'v' || (p % 4) AS v, min(p) AS p FROM r GROUP BY ALL) GROUP BY b)
SELECT min(p) AS _pos, coalesce(arg_min(p_type, p) FILTER (p % 3 > 0), '') AS description, products, links FROM r JOIN o USING (b) JOIN l USING (b) GROUP BY b, products, links""")
def q_merge_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of the same name as one, with what each adds to the first."""
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|").alias("links" if f == "url" else "products")
    return merge_brands(_brands(spark, sf_dir)).select("_pos", "description", names("products", "name"), names("external_links", "url"))


@query("""
WITH r AS (SELECT lower(p_brand) AS b, p_partkey AS p, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
i AS (SELECT b, p, n, 0 AS o, 'x' || (p % 5) AS item FROM r UNION ALL SELECT b, p, n, 1, CASE WHEN p % 4 = 0 THEN ' ' ELSE 'Y' || (p % 3) END FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY b, trim(lower(item)) ORDER BY n, o) AS m FROM i)
SELECT (SELECT count(*) FROM part) AS brands_listed, (SELECT count(DISTINCT b) FROM r) AS brands, (SELECT count(*) FROM k WHERE n = 1 OR (m = 1 AND trim(item) <> '')) AS products, (SELECT count(*) FROM pages) AS pages""")
def q_catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue in one row of counts."""
    from provender.plans.catalog import catalog_stats

    rows = _brands(spark, sf_dir)
    return catalog_stats(rows, merge_brands(rows), read(spark, sf_dir, "pages"))


@query("""
WITH f AS (SELECT p_partkey AS p, 0 AS o, 'x' || (p_partkey % 5) AS product_name FROM part UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE 'Y' || (p_partkey % 3) END FROM part)
SELECT p AS _pos, product_name, 'u' || p AS catalog_source FROM f ORDER BY p, o LIMIT 101""")
def q_catalog_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first products of a catalogue in order, as targets: the operator's own limit."""
    return catalog_targets(_brands(spark, sf_dir).repartition(4), 101).select("_pos", "product_name", "catalog_source")


@query("""
WITH i AS (SELECT l_suppkey AS u, l_orderkey * 10 + l_linenumber AS o, l_partkey % 40 AS p, l_quantity - 10 AS q FROM lineitem),
f AS (SELECT u, p, min(o) AS o, arg_min(q, o * 1000 + q) AS q FROM i WHERE q > 0 AND p % 8 > 0 GROUP BY u, p)
SELECT u AS user, CAST(p AS VARCHAR) AS product_id, CAST(q AS DOUBLE) AS quantity, row_number() OVER (PARTITION BY u ORDER BY o, CAST(p AS VARCHAR)) - 1 AS ord FROM f""")
def q_basket_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved baskets taken up again: the first good row of each product."""
    p = F.col("l_partkey") % 40
    key = F.when(p % 16 == 0, " NaN").when(p % 8 == 0, "﻿").when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("　"), p, F.lit("﻿"))).otherwise(p.cast("string"))
    return restored(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), key.alias("product_id"), (F.col("l_quantity") - 10).alias("quantity")))


#: Businesses by nation, with registry addresses for every fifth; pages as results whose titles tell by key what the page is.
SITES = """
WITH b AS (SELECT n_nationkey AS k, 'ab' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'food' AS core FROM nation),
r AS (SELECT k, page_id AS rank, 'https://' || CASE WHEN page_id % 6 = 0 THEN 'www.facebook.com' ELSE 'h' || (page_id % 9) || '.example' END || '/' AS url, page_id % 4 AS t FROM b JOIN pages ON page_id % 25 = k WHERE k % 5 > 0),
d AS (SELECT *, url LIKE '%facebook%' AS ex, CASE t WHEN 0 THEN 'full_name,unified_number' WHEN 3 THEN 'core_name' WHEN 1 THEN CASE WHEN (rank % 9) % 3 = 1 THEN 'core_name_in_page' END END AS evidence FROM r),
w AS (SELECT *, min(CASE WHEN NOT ex AND evidence IS NOT NULL THEN rank END) OVER (PARTITION BY k, url) AS f FROM d),
a AS (SELECT *, coalesce(NOT ex AND evidence IS NOT NULL AND rank = f, false) AS acc FROM w), s AS (SELECT *, sum(CAST(acc AS INT)) OVER (PARTITION BY k ORDER BY rank) AS s FROM a),
found AS (SELECT k, url, 'search' AS discovery_method, evidence FROM s WHERE acc AND s <= 2 UNION ALL SELECT k, 'https://own' || k || '.example/', 'registry_field', '' FROM b WHERE k % 5 = 0 UNION ALL SELECT k, 'http://two.example/', 'registry_field', '' FROM b WHERE k % 10 = 0)"""


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k, p = F.col("n_nationkey"), F.col("page_id")
    core = F.concat(F.lit("ab"), F.lpad(k.cast("string"), 2, "0"), F.lit("food"))
    nations = read(spark, sf_dir, "nation")
    number = F.lpad((k + 12345600).cast("string"), 8, "0")
    business = nations.select(k.cast("string").alias("business_id"), F.concat(core, F.lit("股份有限公司")).alias("name"), number.alias("number"), F.when(k % 7 == 1, "timeout").alias("error"))
    sites = F.concat(F.lit("見 https://own"), k, F.lit(".example/#top、"), F.when(k % 10 == 0, F.lit("HTTP://two.example。 https://www.facebook.com/x")).otherwise(""))
    registry = nations.where(k % 5 == 0).select(k.cast("string").alias("business_id"), F.lit(0).cast("long").alias("_pos"), F.create_map(F.lit("公司網址"), F.regexp_replace(sites, "、", " "), F.lit("備註"), F.lit("https://not.example/")).alias("record"))
    url = F.when(p % 6 == 0, "https://www.facebook.com/").otherwise(F.concat(F.lit("https://duckduckgo.com/l/?uddg="), F.url_encode(F.concat(F.lit("https://h"), p % 9, F.lit(".example/#x")))))
    named = read(spark, sf_dir, "pages").join(nations, p % 25 == k)
    title = F.when(p % 4 == 0, F.concat(F.upper(core), F.lit(" 股份有限公司 "), number)).when(p % 4 == 1, "AB shop").when(p % 4 == 3, F.concat(F.lit("about "), core)).otherwise("zz")
    results = named.select(k.cast("string").alias("business_id"), p.alias("rank"), url.alias("raw_url"), title.alias("title"), F.lit("text").alias("description"))
    text = F.array_join(F.collect_set(F.concat(core, F.lit(" "))), "")  # page 1, 4 and 7 name everybody, 2, 5 and 8 nobody, the others weren't fetched
    everybody = nations.agg(text.alias("t"))
    pages = spark.range(9).where("id % 3 > 0").join(F.broadcast(everybody)).select(F.concat(F.lit("https://h"), "id", F.lit(".example/")).alias("url"), F.when(F.col("id") % 3 == 1, F.col("t")).otherwise("nothing").alias("html"))
    return business, registry, results, pages


@query(f"{SITES} SELECT CAST(k AS VARCHAR) AS business_id, url, discovery_method, evidence FROM found")
def q_website_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web sites of businesses: from the registry, or else from search results by title, number and page."""
    from provender.plans.websites import checked, discover

    business, registry, results, pages = _sites(spark, sf_dir)
    found = checked(discover(business, registry, results, pages, 2)[0])
    return found.select("business_id", "url", "discovery_method", F.array_join("match_evidence", ",").alias("evidence"))


@query(f"""{SITES}, n AS (SELECT k, (SELECT count(*) FROM found WHERE found.k = b.k) AS c FROM b)
SELECT count(*) AS tested, count(*) FILTER (c > 0) AS with_candidates, CAST(sum(c) AS BIGINT) AS urls, count(*) FILTER (c = 0 AND k % 7 <> 1) AS without, count(*) FILTER (c = 0 AND k % 7 = 1) AS errors FROM n""")
def q_website_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many businesses have web sites, in one row."""
    from provender.plans.websites import discover, website_stats

    business, registry, results, pages = _sites(spark, sf_dir)
    return website_stats(discover(business, registry, results, pages, 2)[1])


@query("""
WITH t AS (SELECT p_partkey AS k, replace(p_name, ' ', '、') AS n FROM part),
s AS (SELECT k, CASE k % 8 WHEN 0 THEN n || '(a、b)；[c(d,e)]' WHEN 1 THEN n || '、 、z' WHEN 2 THEN n || ',,(' WHEN 3 THEN n || '(a]' WHEN 4 THEN n || ',' WHEN 5 THEN ' ' WHEN 6 THEN n || '、' ELSE n || '（a、b)' END AS text, len(string_split(n, '、')) AS w FROM t)
SELECT k AS p_partkey, CASE k % 8 WHEN 0 THEN w + 1 WHEN 1 THEN w + 1 WHEN 6 THEN w ELSE 0 END AS n,
  CASE k % 8 WHEN 2 THEN 'empty_ingredient_between_separators' WHEN 3 THEN 'unbalanced_ingredient_brackets' WHEN 4 THEN 'trailing_ingredient_separator' WHEN 5 THEN 'empty_content_label' WHEN 7 THEN 'unbalanced_ingredient_brackets' END AS error,
  CASE k % 8 WHEN 0 THEN w WHEN 1 THEN w + 1 WHEN 2 THEN w + 1 WHEN 5 THEN 0 ELSE w END AS lenient FROM s""")
def q_split_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredient lists with brackets and with every kind of error, under both sets of rules."""
    from provender.functions.ingredients import split_lenient, split_strict

    n = F.replace("p_name", F.lit(" "), F.lit("、"))
    ends = ["(a、b)；[c(d,e)]", "、 、z", ",,(", "(a]", ",", None, "、", "（a、b)"]
    text = F.lit(" ")
    for i, end in enumerate(ends):
        text = text if end is None else F.when(F.col("p_partkey") % 8 == i, F.concat(n, F.lit(end))).otherwise(text)
    rows = read(spark, sf_dir, "part").select("p_partkey", split_strict(text).alias("s"), split_lenient(text).alias("l"))
    return rows.select("p_partkey", F.size("s.names").cast("long").alias("n"), "s.error", F.size("l").cast("long").alias("lenient"))


@query("""
SELECT p_partkey, 2 + p_partkey % 2 AS n, chr(CAST(57344 + p_partkey % 7 AS INTEGER)) || p_name || CASE WHEN p_partkey % 2 = 0 THEN '(a、' || chr(57345) || ')' ELSE '' END AS first, '水' || chr(57350) AS last,
  CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS lenient FROM part""")
def q_split_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with code points for private use, where code pages put characters of their own: they are no separators."""
    from provender.functions.ingredients import split_lenient, split_strict

    k = F.col("p_partkey")
    own = F.element_at(F.array(*(F.lit(chr(0xE000 + i)) for i in range(7))), (k % 7 + 1).cast("int"))
    first = F.concat(own, "p_name", F.when(k % 2 == 0, F.lit("(a、\ue001)")).otherwise(F.lit("")))
    text = F.concat(first, F.when(k % 2 == 0, F.lit("、")).otherwise(F.lit("、糖，")), F.lit("水\ue006"))
    rows = read(spark, sf_dir, "part").select("p_partkey", split_strict(text).alias("s"), split_lenient(text).alias("l"))
    return rows.select("p_partkey", F.size("s.names").cast("long").alias("n"), F.get("s.names", F.lit(0)).alias("first"), F.element_at("s.names", -1).alias("last"), F.size("l").cast("long").alias("lenient"))


def _brand_site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """List pages by nation, a site map and brand pages, made from suppliers; some pages are missing and some say nothing."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = read(spark, sf_dir, "supplier").select(k, n)
    card = F.concat(F.lit('<div class="item cate-'), n, F.lit('"><a href="brands-s'), k, F.lit('.html">S'), k, F.lit("</a></div>"))
    link = F.concat(F.lit('<a href="/Brands-s'), k, F.lit('.html">M'), k, F.lit("</a>"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", c.alias("h")))), lambda x: x["h"]), "")
    lists = rows.where(k % 7 > 0).groupBy(n).agg(ordered(card).alias("cards"))
    lists = lists.select(F.concat(F.lit("https://a.tw/n"), F.lpad(n.cast("string"), 2, "0")).alias("url"), F.concat(F.lit('<a data-rel="cate-'), n, F.lit('">Cat '), n, F.lit("</a>"), "cards").alias("html"))
    maps = rows.where(k % 3 == 0).groupBy((k % 4).alias("m")).agg(ordered(link).alias("html")).select(F.concat(F.lit("https://a.tw/m"), "m").alias("url"), "html")
    box = lambda name: F.concat(F.lit('<div class="product-box"><a data-name="'), name, F.lit('"></a><img src="i.png"></div>'))
    body = F.concat(F.lit('<div class="product-introduction"><h2>Shop '), k % 30, F.lit('</h2><div class="bd">'), F.when(k % 2 == 0, F.concat(F.lit("said "), k)).otherwise(F.lit("")), F.lit("</div>"), box(F.concat(F.lit("X"), k % 3)), box(F.concat(F.lit("y"), k)), F.lit("</div>"))
    pages = rows.where(k % 5 > 0).select(F.when(k % 7 > 0, F.concat(F.lit("https://a.tw/brands-s"), k, F.lit(".html"))).otherwise(F.concat(F.lit("https://a.tw/Brands-s"), k, F.lit(".html"))).alias("url"), F.when(k % 13 == 0, F.lit("<p>")).otherwise(body).alias("html"))
    return lists, maps, pages


BRANDS = """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
i AS (SELECT k, 0 AS o, 'https://a.tw/n' || lpad(CAST(n AS VARCHAR), 2, '0') AS base, 'S' || k AS name, 'https://a.tw/brands-s' || k || '.html' AS url, 'Cat ' || n AS category FROM s WHERE k % 7 > 0
  UNION ALL SELECT k, 1, 'https://a.tw/m' || (k % 4), 'M' || k, 'https://a.tw/Brands-s' || k || '.html', '' FROM s WHERE k % 3 = 0 AND k % 7 = 0),
p AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'page missing' WHEN k % 13 = 0 THEN 'no introduction' END AS error FROM i)"""


@query(f"{BRANDS} SELECT name, url, category, error FROM p")
def q_brand_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of brands, lists before site maps, and why nothing is known of some."""
    from provender.plans.catalog import brand_index, brand_pages

    lists, maps, pages = _brand_site(spark, sf_dir)
    return brand_pages(brand_index(lists, maps), pages).select("name", "url", "category", "error")


@query(f"""{BRANDS},
g AS (SELECT *, 'Shop ' || (k % 30) AS shop, row_number() OVER (PARTITION BY k % 30 ORDER BY o, base, k) AS r FROM p WHERE error IS NULL),
t AS (SELECT shop, r, 0 AS place, 'X' || (k % 3) AS item FROM g UNION ALL SELECT shop, r, 1, 'y' || k FROM g),
u AS (SELECT *, row_number() OVER (PARTITION BY shop, item ORDER BY r, place) AS m FROM t)
SELECT shop AS name, min(url) FILTER (r = 1) AS url, min(category) FILTER (r = 1) AS category, coalesce(arg_min('said ' || k, r) FILTER (k % 2 = 0), '') AS description, (SELECT string_agg(item, '|' ORDER BY u.r, place) FROM u WHERE u.shop = g.shop AND (u.r = 1 OR m = 1)) AS products FROM g GROUP BY shop""")
def q_build_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of brands and products from all pages."""
    from provender.plans.catalog import brand_index, brands

    lists, maps, pages = _brand_site(spark, sf_dir)
    merged = brands(brand_index(lists, maps), pages)
    return merged.select("name", "url", "category", "description", F.array_join(F.transform("products", lambda p: p["name"]), "|").alias("products"))


@query(f"""{BRANDS}, g AS (SELECT k % 30 AS shop, k % 3 AS x, k FROM p WHERE error IS NULL)
SELECT (SELECT count(*) FROM p) AS brands_listed, (SELECT count(DISTINCT shop) FROM g) AS brands, (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT count(DISTINCT x) + count(*) AS c FROM g GROUP BY shop)) AS products, (SELECT count(*) FROM g) AS fetched, (SELECT count(*) FROM p WHERE error IS NOT NULL) AS failed""")
def q_catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was listed, read, merged, and failed."""
    from provender.plans.catalog import brand_index, brands, catalog_stats

    lists, maps, pages = _brand_site(spark, sf_dir)
    index = brand_index(lists, maps)
    return catalog_stats(index, brands(index, pages), pages)


def _two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of the catalogue and of a shop for each part, and the shop's errors: pages that are missing or can't be read."""
    from provender.plans.catalog import from_catalogue, from_shop

    k = F.col("p_partkey")
    page = F.concat(F.lit("https://a.tw/c"), k % 20)
    parts = read(spark, sf_dir, "part").select(k, page.alias("page"))
    targets = parts.select(k.alias("target_id"), F.concat(F.lit("item "), k).alias("product_name"), F.concat(F.lit("Brand"), k % 9).alias("brand"), F.col("page").alias("catalog_source"))
    anchor = F.concat(F.lit('<a data-rel="'), k, F.lit('" data-name="ITEM '), k, F.lit('"></a>'))
    pages = parts.where(k % 3 > 0).groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(anchor)), "").alias("html")).select(F.col("page").alias("url"), "html")
    details = parts.select(k.cast("string").alias("product_id"), F.concat(F.lit("<h1>item "), k, F.lit(' <span class="gray">'), k % 7, F.lit(" ml</span></h1>")).alias("html"))
    own = from_catalogue(targets, pages, details, "own")
    result = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"Brand'), k % 9, F.lit(" item "), k, F.lit('","url":"https://s.tw/'), k, F.lit('"}</script>'))
    calories = F.when(k % 11 == 0, F.lit("1.2.3")).otherwise((k % 50).cast("string"))
    table = F.concat(F.lit("<table><tr><td>內容物（成分）</td><td>水、茶</td></tr><tr><td>營養標示</td><td>每一份量 5 毫升<br>熱量 "), calories, F.lit(" 大卡</td></tr></table>"))
    data = F.concat(F.lit('[{"goodsBarcode": 1, "goodsShowName": 2, "goodsSpec": 3, "details": 4}, "471'), k, F.lit('", "Brand'), k % 9, F.lit("item "), k, F.lit('", " ", "'), table, F.lit('"]'))
    shop_pages = parts.where(k % 7 > 0).select(F.concat(F.lit("https://s.tw/"), k).alias("url"), F.concat(F.lit('<script id="__NUXT_DATA__">'), data, F.lit("</script>")).alias("html"))
    shop, errors = from_shop(targets, parts.select(k.alias("target_id"), result.alias("html")), shop_pages, "shop")
    return own, shop, errors


@query("""
WITH own AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 > 0), shop AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0)
SELECT k AS target_id, 'own' AS source_name, 1 AS rank, 1.0 AS match_score, 'item ' || k AS matched_name, NULL AS barcode, CAST(k % 7 AS DOUBLE) AS amount, NULL AS calories, 0 AS ingredients FROM own
UNION ALL SELECT k, 'shop', CASE WHEN k % 3 > 0 THEN 2 ELSE 1 END, 1.0, 'Brand' || (k % 9) || 'item ' || k, '471' || k, 5.0, CAST(k % 50 AS DOUBLE), 2 FROM shop""")
def q_collect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two sources for every target, ranked together."""
    from provender.plans.catalog import match_candidates

    own, shop, _ = _two_sources(spark, sf_dir)
    calories = F.col("nutrition.calories.value")
    own = kept(own, "own")  # read twice: groups are counted before they are put in order
    return match_candidates(own, shop).select("target_id", "source_name", "rank", "match_score", "matched_name", "barcode", F.col("serving.amount").alias("amount"), calories.alias("calories"), F.size("ingredients").alias("ingredients"))


@query("SELECT p_partkey AS target_id, 'shop' AS source_name, CASE WHEN p_partkey % 7 = 0 THEN 'page missing' ELSE 'invalid_numeral' END AS error FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0")
def q_candidate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets for which a source failed, and why."""
    return _two_sources(spark, sf_dir)[2]


@query("""
WITH n AS (SELECT * FROM (VALUES (0, 'calories', 'kcal', 2000.0), (1, 'protein', 'g', 60.0), (2, 'fat', 'g', 60.0), (3, 'saturatedFat', 'g', 18.0), (4, 'transFat', 'g', NULL), (5, 'carbohydrates', 'g', 300.0), (6, 'sugar', 'g', NULL), (7, 'sodium', 'mg', 2000.0)) t(i, nutrient, unit, reference)),
f AS (SELECT p_partkey AS id, nutrient, unit, CASE WHEN (p_partkey + i) % 9 > 0 THEN CAST(p_size * (i + 1) AS DOUBLE) END AS value, reference, p_partkey % 300 AS d FROM part, n)
SELECT id, nutrient, value, CASE WHEN value IS NULL THEN '目前尚無資料' ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) || ' ' || unit END AS label, round(value / reference * 100, 9) AS pct, round(CASE WHEN value / reference * 100 > 100 THEN 100 ELSE value / reference * 100 END, 9) AS progress, 's' AS source,
  CAST(date_diff('day', DATE '1998-01-01' + CAST(d AS INTEGER), DATE '1998-10-28') AS INTEGER) AS days, date_diff('day', DATE '1998-01-01' + CAST(d AS INTEGER), DATE '1998-10-28') > 180 AS stale FROM f""")
def q_nutrition_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nutrient of every product: amount, label, share of the daily reference, source and its freshness."""
    from provender.plans.products import product_facts

    k = F.col("p_partkey")
    amounts = F.struct(*(F.struct(F.when((k + i) % 9 > 0, F.col("p_size") * (i + 1)).cast("double").alias("value"), F.lit(UNITS[n]).alias("unit")).alias(n) for i, n in enumerate(NAMES)))
    source = F.array(F.struct(F.lit("s").alias("id"), F.lit("n").alias("name"), F.lit("https://x/").alias("url"), F.date_format(F.date_add(F.to_date(F.lit("1998-01-01")), (k % 300).cast("int")), "yyyy-MM-dd").alias("verified_at")))
    rows = read(spark, sf_dir, "part").select(k.alias("_pos"), k.alias("id"), F.col("p_name").alias("name"), amounts.alias("nutrition"), source.alias("sources"), F.lit(" s").alias("nutritionSource"), F.array().cast("array<struct<name:string,sourceId:string>>").alias("ingredients"))
    facts = product_facts(rows, F.to_date(F.lit("1998-10-28")))
    return facts.select("id", "nutrient", "value", "label", F.round("pct", 9).alias("pct"), F.round("progress", 9).alias("progress"), F.col("source.id").alias("source"), F.col("freshness.elapsed_days").alias("days"), F.col("freshness.is_stale").alias("stale"))


@query("""
WITH n AS (SELECT * FROM (VALUES (0, 'calories', 'kcal', 2000.0), (1, 'protein', 'g', 60.0), (2, 'fat', 'g', 60.0), (3, 'saturatedFat', 'g', 18.0), (4, 'transFat', 'g', NULL), (5, 'carbohydrates', 'g', 300.0), (6, 'sugar', 'g', NULL), (7, 'sodium', 'mg', 2000.0)) t(i, nutrient, unit, reference)),
f AS (SELECT l_orderkey AS "user", nutrient, unit, reference, bool_and((p_partkey + i) % 60 > 0) AS good, sum(l_quantity * (p_size * (i + 1) * 2 + 1)) / 4 AS v FROM lineitem JOIN part ON p_partkey = l_partkey CROSS JOIN n GROUP BY ALL)
SELECT "user", nutrient, CAST(v AS DOUBLE) AS value, unit, round(v / reference * 100, 6) AS pct, CASE WHEN v / reference * 100 >= 100 THEN 'reached' WHEN v / reference * 100 >= 80 THEN 'near' WHEN reference IS NOT NULL THEN 'normal' END AS status FROM f WHERE good""")
def q_basket_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of baskets in all nutrients, in fractions, with their share of the daily reference and its status."""
    from provender.plans.products import basket_totals

    k = F.col("p_partkey")
    amounts = F.struct(*(F.struct(F.when((k + i) % 60 > 0, F.col("p_size") * (i + 1) / 2 + 0.25).cast("double").alias("value"), F.lit(UNITS[n]).alias("unit")).alias(n) for i, n in enumerate(NAMES)))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("user"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("double").alias("quantity"))
    out = basket_totals(items, read(spark, sf_dir, "part").select(k.alias("id"), amounts.alias("nutrition")))
    return out.select("user", "nutrient", "value", "unit", F.round("pct", 6).alias("pct"), "status")


@query("""
WITH r AS (SELECT p_partkey AS k, p_partkey % 6 AS m FROM part)
SELECT k AS _pos, CASE WHEN m = 0 THEN 's1' WHEN m = 1 THEN 's2' END AS "nutritionSource", CASE WHEN m IN (2, 4) THEN 'no such source' WHEN m IN (3, 5) THEN 'missing or not a text' END AS warning, CASE WHEN m = 4 THEN 0 ELSE 2 END AS sources FROM r""")
def q_load_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with sources: where a product's nutrition comes from, if that is one of them."""
    from provender.operators.validate import checked_products

    k = F.col("p_partkey")
    sources = F.when(k % 6 == 4, F.lit('[{"id":"s1","name":"n","url":"ftp://x"},{"id":" ","name":"n","url":"https://x"}]')).otherwise(F.lit('[{"id":"s1","name":"n","url":"https://x/a"},{"id":" s2 ","name":"m","url":"http://y","verified_at":"2026-02-03"},{"id":"s1","name":"again","url":"https://z"}]'))
    named = F.element_at(F.array(*map(F.lit, ('" s1"', '"s2"', '"s3"', '5', '"s1"', '"undefined"'))), (k % 6 + 1).cast("int"))
    text = F.concat(F.lit('{"id":"p'), k, F.lit('","name":"n","sources":'), sources, F.lit(',"nutritionSource":'), named, F.lit("}"))
    rows = checked_products(spread(read(spark, sf_dir, "part")).select(k.cast("long").alias("_pos"), F.try_parse_json(text).alias("record")))
    found = F.get(F.filter("warnings", lambda w: w["field"] == "nutritionSource"), F.lit(0))["reason"]
    return rows.select("_pos", "nutritionSource", found.alias("warning"), F.size("sources").alias("sources"))


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'full_name_in_page' WHEN 1 THEN 'core_name_in_page' END AS evidence FROM pages""")
def q_page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page shows of a business's name: the whole of it, its core, or nothing."""
    from provender.functions.evidence import core_name, match_key, page_evidence

    k = F.col("page_id")
    name = F.concat(F.lit("甲乙"), F.lit("丙丁"), F.lit("食品股份有限公司"))
    own = F.when(k % 4 == 0, F.lit("<p> 甲乙 丙丁 食品股份有限公司 </p>")).when(k % 4 == 1, F.concat(F.lit("<b>"), core_name(name), F.lit("</b>"))).otherwise(F.lit("甲"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat("html", own).alias("page"), name.alias("name"))
    rows = rows.select("page_id", match_key("page").alias("_p"), match_key("name").alias("_n"), match_key(core_name(F.col("name"))).alias("_c"))
    return rows.select("page_id", F.get(page_evidence(F.col("_p"), F.col("_n"), F.col("_c")), F.lit(0)).alias("evidence"))


@query("""
SELECT 'n' || n_nationkey AS identity FROM nation WHERE (n_nationkey % 4 = 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)) OR (n_nationkey % 5 = 1 AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey))""")
def q_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses to evaluate again: those with one registry record that changed, or one search result more than last time."""
    from provender.operators.joins import input_signatures

    registry = read(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("identity"), "s_nationkey", "s_suppkey", "s_name")
    results = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("identity"), "c_nationkey", "c_custkey", "c_name")
    first = registry.groupBy(F.col("s_nationkey").alias("n")).agg(F.min("s_suppkey").alias("least"))
    changed = registry.join(first, F.col("s_nationkey") == F.col("n")).withColumn("s_name", F.when((F.col("n") % 4 == 0) & (F.col("s_suppkey") == F.col("least")), F.lit("renamed")).otherwise(F.col("s_name"))).drop("n", "least")
    newest = results.groupBy("c_nationkey").agg(F.max("c_custkey").alias("c_custkey"))
    before = results.join(newest.where("c_nationkey % 5 = 1"), ["c_nationkey", "c_custkey"], "left_anti")
    settings = {"provider": "table", "max": 5}
    now = input_signatures("identity", {"registry": changed, "results": results}, settings)
    return unfinished(now, input_signatures("identity", {"results": before, "registry": registry}, settings)).select("identity")
