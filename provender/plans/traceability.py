"""Trace records: normalised, classified, built into candidates, analysed, promoted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions.ingredients import split_strict
from provender.functions.keys import candidate_id
from provender.functions.nutrition import NAMES, UNITS, anomalies, complete_non_negative, nutrient, quantity, valid_amount
from provender.functions.text import clean, filled
from provender.operators.classify import CLASSES, candidate_issues, class_counts, classified, eligible, ingredients_parsed, issue_category
from provender.operators.ordered import appended, duplicates, occurrence_ids
from provender.operators.schema import as_variant, product_schema, schema_validate, text_in
from provender.operators.validate import catalogue_faults
from provender.sources.io import TRACE_FIELDS, TRACE_NUTRIENTS, ContractError, first_rows
from provender.sources.shared import computed, kept, released, spread


def normalize(records: DataFrame) -> DataFrame:
    """Typed trace records of VARIANT rows (_pos, record): values that aren't texts count as missing."""
    texts = {**TRACE_FIELDS, **{f"_{n}": f for n, f in TRACE_NUTRIENTS.items()}}
    # a record is gone through once for all its fields, as each path looks them up anew; each amount is read once, however often it is looked at
    kind = ", ".join(f"`{f}`: variant" for f in dict.fromkeys(texts.values()))
    records = computed(records.select("_pos", F.try_variant_get("record", "$", f"struct<{kind}>").alias("_r")))
    records = computed(records.select("_pos", *(text_in(F.col("_r")[f]).alias(n) for n, f in texts.items())))
    fields = {n: F.col(n) for n in texts}
    out = records.select(
        "_pos",
        *(clean(fields[n]).alias(n) for n in ("companyName", "productName", "packageSpecification", "traceabilityCode")),
        F.lit(None).cast("string").alias("barcode"),
        quantity(fields["serving"]).alias("serving"),
        F.struct(*(nutrient(fields[f"_{n}"], UNITS[n]).alias(n) for n in TRACE_NUTRIENTS)).alias("nutrition"),
        F.coalesce(fields["contentLabel"], F.lit("")).alias("contentLabel"),
    )
    return computed(out).withColumn("anomalies", anomalies(F.col("packageSpecification"), F.col("nutrition")))


def collection_stats(rows: DataFrame) -> DataFrame:
    """One row: records, those with all nutrients, those with an empty label, anomalies."""
    all_values = reduce(lambda a, b: a & b, (F.col("nutrition")[n]["value"].isNotNull() for n in NAMES))
    return rows.agg(F.count("*").alias("records"), F.count_if(all_values).alias("complete_nutrition"), F.count_if(F.col("contentLabel") == "").alias("empty_label"), F.coalesce(F.sum(F.size("anomalies")), F.lit(0)).alias("anomaly_items"), F.count_if(F.size("anomalies") > 0).alias("anomaly_records"))


def classify_products(rows: DataFrame, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and the count of each class."""
    out = classified(first_rows(rows, sample))
    return out, class_counts(out)


def build_candidates(rows: DataFrame, source: dict[str, str], sample: int | None = None) -> DataFrame:
    """Candidate products of the rows that have all nutrients and ingredients, the first ``sample`` of them.

    source: id, name, provider, dataset_url, download_url, fetched_at. Brand and barcode are never
    taken from elsewhere.
    """
    # read twice in numbering, so parsed once
    chosen = kept(first_rows(computed(rows).where(F.col("classification") == CLASSES[0]), sample), "chosen")
    identity = [F.col(c) for c in ("companyName", "productName", "packageSpecification")]
    chosen = spread(occurrence_ids(chosen, candidate_id(F.col("traceabilityCode"), *identity), "candidateId"))
    split = split_strict("contentLabel")
    src = F.struct(*(F.lit(v).alias(k) for k, v in source.items()))
    return chosen.withColumn("_i", split).select(
        "_pos", "candidateId", "companyName", F.lit(None).cast("string").alias("brand"), "productName", "packageSpecification", "traceabilityCode", "barcode", "serving", "nutrition",
        F.transform("_i.names", lambda n: F.struct(n.alias("name"), F.lit(source["id"]).alias("sourceId"))).alias("ingredients"),
        F.col("contentLabel").alias("ingredientsRaw"), F.col("_i.error").alias("ingredientsParseError"), src.alias("source"), F.lit(source.get("fetched_at")).alias("fetched_at"), "anomalies",
    )


def candidate_stats(scanned: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: scanned and selected records, what is missing, anomalies, duplicate codes and products."""
    n = scanned.agg(F.count("*").alias("scanned"))
    own = candidates.agg(F.count("*").alias("selected"), F.count_if(~valid_amount(F.col("serving"))).alias("missing_serving"), F.count_if(F.col("ingredientsParseError").isNotNull()).alias("ingredient_parse_failures"), F.coalesce(F.sum(F.size(F.filter("anomalies", lambda a: a.startswith("unparsed_nutrition:")))), F.lit(0)).alias("nutrition_anomalies"), F.count_if(F.size("anomalies") > 0).alias("anomaly_rows"))
    codes = duplicates(candidates, F.col("traceabilityCode"), blank_counts=False).select(F.col("values").alias("duplicate_codes"), F.col("surplus").alias("duplicate_code_records"))
    same = duplicates(candidates, F.struct("companyName", "productName", "packageSpecification")).select(F.col("values").alias("duplicate_products"), F.col("surplus").alias("duplicate_product_records"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [n, own, codes, same])  # one row each


def formal_product(promotion: bool) -> Column:
    """A candidate as a formal product: the JSON object that this struct is without its null fields.

    For analysis the optional parts that aren't valid are left out, and maker and trace code too;
    for promotion those are in, and ingredients refer to the source.
    """
    src, good_source = F.col("source"), filled(F.col("source.id")) & filled(F.col("source.name")) & filled(F.col("source.dataset_url"))
    nutrition_ok, serving_ok = complete_non_negative(F.col("nutrition")), valid_amount(F.col("serving"))
    serving = F.struct(F.col("serving.value").alias("amount"), clean(F.col("serving.unit")).alias("unit"))
    nutrition = F.struct(*(F.struct(F.col("nutrition")[n]["value"].alias("value"), clean(F.col("nutrition")[n]["unit"]).alias("unit")).alias(n) for n in NAMES))
    sources = F.array(F.struct(clean(src["id"]).alias("id"), clean(src["name"]).alias("name"), clean(src["dataset_url"]).alias("url")))
    names = F.transform("ingredients", lambda i: F.struct(clean(i["name"]).alias("name"), clean(src["id"]).alias("sourceId")))
    fields = {"id": F.col("candidateId"), "name": F.col("productName")}
    if promotion:
        fields |= {"manufacturer": F.col("companyName"), "traceabilityCode": F.col("traceabilityCode"), "ingredients": names}
    else:
        fields |= {"brand": F.when(filled(F.col("brand")), clean(F.col("brand"))), "barcode": F.when(filled(F.col("barcode")), clean(F.col("barcode"))), "ingredients": F.when(F.col("ingredientsParseError").isNull(), F.col("ingredients"))}
    fields |= {"serving": F.when(serving_ok, serving), "nutrition": F.when(nutrition_ok, nutrition), "sources": F.when(good_source, sources), "nutritionSource": F.when(good_source & nutrition_ok, clean(src["id"]))}
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def promotion_analysis(candidates: DataFrame, schema: dict | None = None, sample: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records with issues and schema status, counts by issue, counts by category, and one row of totals."""
    rows = first_rows(candidates, sample).withColumns({"issues": candidate_issues(), "product": formal_product(promotion=False)})
    rows = schema_validate(rows, "product", schema or product_schema()).withColumn("issueCategory", issue_category(F.col("issues")))
    records = rows.select("_pos", "candidateId", "traceabilityCode", F.col("status").alias("schemaStatus"), "issueCategory", "issues", F.col("first_error").alias("schemaValidationError"))
    by_issue = records.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    by_category = records.groupBy("issueCategory").agg(F.count("*").alias("n"))
    blocking = F.array(F.lit("missing_serving"), F.lit("ingredients_parse_error"), F.lit("nutrition_structure_error"))
    totals = records.agg(F.count("*").alias("candidates"), F.count_if(F.expr("schemaStatus = 'ready'")).alias("schema_ready"), F.count_if(F.expr("schemaStatus = 'blocked'")).alias("schema_blocked"), F.count_if(~F.arrays_overlap("issues", blocking)).alias("complete_ready"), F.count_if(F.expr("issueCategory = 'multiple_issues'")).alias("multiple_issues"))
    return records, by_issue, by_category, totals


FLAGS = {"dup_id": "dup and kind = 'id'", "dup_code": "dup and kind = 'code'", "dup_product": "dup and kind = 'product'", "old_id": "old and kind = 'id'", "old_code": "old and kind = 'code'"}


def judged(candidates: DataFrame, products: DataFrame, schema: dict | None = None) -> DataFrame:
    """Candidates with what speaks for and against each: eligible, converted, schema_ok, dup_*, old_*, safe.

    Rows are converted and held against the schema once, and kept; a product's VARIANT is made where it is asked for. All keys
    of all kinds are then counted in one grouping, together with those of products; the few that are common meet the positions
    that have them, and rows are moved once, by position, which has to tell them apart.
    """
    source_ok = filled(F.col("source.id")) & filled(F.col("source.name")) & filled(F.col("source.dataset_url"))
    rows = candidates.withColumn("eligible", eligible()).withColumn("converted", F.col("eligible") & F.coalesce(source_ok, F.lit(False)))
    rows = rows.withColumns({"id": F.col("candidateId"), "_product": F.when(F.col("converted"), formal_product(promotion=True))})
    rows = schema_validate(rows, "_product", schema or product_schema()).withColumn("schema_ok", F.col("converted") & (F.col("status") == "ready")).drop("errors", "status", "first_error", "_product")
    identity = F.when(F.col("eligible"), F.concat_ws("\x1f", *(clean(F.col(c)) for c in ("companyName", "productName", "packageSpecification"))))
    keys = {n: F.when(F.col("converted") & filled(F.col(c)), clean(F.col(c))) for n, c in (("id", "id"), ("code", "traceabilityCode"))} | {"product": identity}
    rows = kept(rows.withColumns({f"_{name}": key for name, key in keys.items()}), "judged")

    def listed(df: DataFrame, columns: dict[str, Column], old: bool) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in columns.items()))
        flat = df.select((F.lit(None).cast("long") if old else F.col("_pos")).alias("_pos"), F.explode(pairs).alias("k"))
        return flat.select("_pos", "k.*").where("value is not null")

    own = listed(rows, {name: F.col(f"_{name}") for name in keys}, False)
    known = listed(products, {n: F.when(filled(F.col(c)), clean(F.col(c))) for n, c in (("id", "id"), ("code", "traceabilityCode"))}, True)
    counts = own.union(known).groupBy("kind", "value").agg(F.count("_pos").alias("n"), (F.count("*") > F.count("_pos")).alias("old"))
    met = own.join(counts.where("n > 1 or (n > 0 and old)").select("kind", "value", F.expr("n > 1").alias("dup"), "old"), ["kind", "value"])
    flags = met.groupBy("_pos").agg(*(F.bool_or(F.expr(c)).alias(name) for name, c in FLAGS.items()))
    out = rows.join(flags, "_pos", "left").withColumns({name: F.coalesce(name, F.lit(False)) for name in FLAGS})
    out = out.withColumn("product", F.when(F.col("converted"), as_variant(formal_product(promotion=True))))
    return out.withColumn("safe", F.col("schema_ok") & F.col("_id").isNotNull() & ~F.col("dup_id") & ~F.col("dup_code") & ~F.col("old_id") & ~F.col("old_code"))


def dry_run(candidates: DataFrame, products: DataFrame, schema: dict | None = None, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What promotion would do: one row, and details (kind, value) in order of what stands in its way.

    products: id, traceabilityCode and, if the whole catalogue to be is to be validated, _pos and product
    (VARIANT): candidates that aren't valid aren't safe, so what fails then is an existing product. rows:
    what judged gives, where that is known already.
    """
    rows = judged(candidates, products, schema) if rows is None else rows

    def values(flag: str, key: str) -> Column:
        return F.countDistinct(F.when(F.col(flag), F.col(key)))

    counts = rows.agg(
        F.count("*").alias("candidates"), F.count_if("eligible").alias("convertible"), F.count_if(~F.col("eligible")).alias("ineligible"), F.count_if(~valid_amount(F.col("serving"))).alias("invalid_serving"),
        F.count_if(~complete_non_negative(F.col("nutrition"))).alias("incomplete_nutrition"), F.count_if(~ingredients_parsed(F.col("ingredients"), F.col("ingredientsParseError"))).alias("ingredient_parse_failures"),
        F.count_if("converted").alias("converted"), F.count_if(F.expr("eligible and not converted")).alias("not_converted"), F.count_if("schema_ok").alias("schema_pass"), F.count_if(F.expr("converted and not schema_ok")).alias("schema_fail"),
        values("dup_id", "_id").alias("duplicate_id_values"), F.count_if("dup_id").alias("duplicate_id_records"), values("dup_code", "_code").alias("duplicate_code_values"), F.count_if("dup_code").alias("duplicate_code_records"),
        values("old_id", "_id").alias("existing_id_conflicts"), values("old_code", "_code").alias("existing_code_conflicts"), F.count_if(F.expr("old_id or old_code")).alias("existing_conflict_records"),
        values("dup_product", "_product").alias("duplicate_product_groups"), F.count_if("dup_product").alias("duplicate_product_records"), F.lit(0).alias("duplicate_product_records_merged"), F.count_if("safe").alias("safe_imports"),
    )
    failed = F.lit(None).cast("string").alias("batch_schema_error")
    if "product" in products.columns:
        old = schema_validate(spread(products.select("_pos", "product")), "product", schema or product_schema()).where("status = 'blocked'")
        first = old.agg(F.min_by(F.concat(F.lit("$.products["), F.col("_pos").cast("string"), F.lit("]"), F.expr("substring(first_error, 2)")), "_pos").alias("batch_schema_error"))
        counts = counts.join(F.broadcast(first))  # one row each
    else:
        counts = counts.select("*", failed)
    counts = counts.select(F.lit("dry-run").alias("mode"), F.lit(False).alias("products_modified"), "*", F.when(F.col("batch_schema_error").isNull(), "pass").otherwise("fail").alias("batch_schema_validation"))
    kinds = {"conversion_failures": ("eligible and not converted", "candidateId"), "schema_failures": ("converted and not schema_ok", "id"), "duplicate_ids": ("dup_id", "_id"), "duplicate_codes": ("dup_code", "_code"), "existing_id_conflicts": ("old_id", "_id"), "existing_code_conflicts": ("old_code", "_code")}
    found = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(k).alias("kind"), F.col(v).alias("value"))) for k, (c, v) in kinds.items())))
    return counts, rows.select(F.explode(found).alias("d")).select("d.*").distinct().orderBy("kind", "value")


def promote(candidates: DataFrame, products: DataFrame, expected: int, schema: dict | None = None) -> DataFrame:
    """products with the safe candidates after them, if the dry run is without conflicts and as large as expected.

    products: _pos, id, traceabilityCode, product (VARIANT). They are written once, so what the dry run validates is what is
    taken over; each product is validated once, an existing one by the dry run and a new one where it is judged.
    """
    products = kept(products.select("_pos", "id", "traceabilityCode", "product"), "existing")
    rows = kept(judged(candidates, products, schema), "promotion")
    counts = dry_run(candidates, products, schema, rows)[0].first()
    zero = ["duplicate_id_values", "duplicate_code_values", "existing_id_conflicts", "existing_code_conflicts", "schema_fail"]
    if counts["batch_schema_validation"] != "pass":
        raise ContractError(f"the catalogue isn't valid: {counts['batch_schema_error']}")
    if bad := [z for z in zero if counts[z]]:
        raise ContractError(f"conflicts: {', '.join(bad)}")
    if not counts["safe_imports"] or counts["safe_imports"] != expected or counts["convertible"] != expected:
        raise ContractError(f"{counts['safe_imports']} safe and {counts['convertible']} convertible candidates, {expected} expected")
    new = rows.where("safe").select("_pos", "id", "traceabilityCode", "product")
    out = kept(appended(products, new), "promoted")
    if catalogue_faults(out).limit(1).count():
        raise ContractError("the catalogue to be written isn't valid")
    released(rows)
    released(products)
    return out

