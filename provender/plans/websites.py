"""Web sites that may belong to a business, with the evidence for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.functions.evidence import core_name, distinctive_prefix, field_urls, match_evidence, match_key, own_url, page_evidence, result_read
from provender.functions.text import clean
from provender.functions.urls import exclusion_reason
from provender.operators.classify import website_status
from provender.operators.joins import excluded_domains, with_excluded, with_pages
from provender.operators.ordered import decide, first_wins
from provender.sources.io import reconcile
from provender.sources.shared import kept

from .registry import NAME, REGISTRATION


def businesses(groups: DataFrame, name: str = NAME, registration: str = REGISTRATION) -> DataFrame:
    """(business_id, idx, name, number, records) of manufacturer groups: the first name that isn't blank."""
    number = clean(F.col("unified_number"))
    names = F.filter(F.transform("records", lambda r: clean(r[name])), lambda n: n != "")
    first = clean(F.get("records", F.lit(0))[registration])
    identity = F.when(number != "", F.concat(F.lit("unified_number:"), number)).otherwise(F.concat(F.lit("missing:"), F.col("idx").cast("string"), F.lit(":"), first))
    return groups.select(identity.alias("business_id"), "idx", F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("name"), number.alias("number"), "records")


def registry_urls(records: DataFrame) -> DataFrame:
    """(business_id, url, field, _pos): addresses in the fields of registry records (business_id, _pos, record map), first ones."""
    flat = records.select("business_id", F.col("_pos").alias("_r"), F.posexplode(field_urls(F.col("record"))).alias("_at", "u"))
    flat = flat.withColumn("url", own_url(F.col("u.raw"))).where("url is not null").withColumn("_o", F.struct("_r", "_at"))
    return first_wins(flat, [F.col("business_id"), F.col("url")], "_o").select("business_id", "url", F.col("u.field").alias("field"), F.col("_o").alias("_pos"))


def evaluate(business: DataFrame, results: DataFrame, pages: DataFrame, most: int = 5, domains: DataFrame | None = None) -> DataFrame:
    """Search results (business_id, rank, raw_url, title, description) of businesses, each with its decision and evidence.

    domains (domain): hosts that aren't looked at; without it those that are known.
    """
    # names are read once a business, and all that is read of a result is one step, as each step is a Python worker beside every task
    names = business.select("business_id", "name", "number", match_key("name").alias("_n"), match_key(core_name(F.col("name"))).alias("_c"))
    text = clean(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    read = results.withColumn("text", text).withColumn("_p", result_read("raw_url", "text"))
    rows = read.withColumn("decoded_url", F.col("_p.decoded_url")).join(names, "business_id")
    rows = with_excluded(rows, F.col("_p.host"), excluded_domains(rows.sparkSession) if domains is None else domains, "_x")
    rows = rows.withColumn("excluded", exclusion_reason(F.col("_p"), F.col("_x")))
    rows = rows.withColumns({name: F.when(F.col("excluded").isNull(), F.col(f"_p.{of}")) for name, of in (("url", "url"), ("_u", "url_key"), ("_plain", "plain"))})
    rows = rows.withColumn("_t", F.col("_p.text_key")).drop("_p", "_x")
    rows = rows.withColumn("evidence", match_evidence(F.col("_u"), F.col("_t"), F.col("_n"), F.col("_c"), F.col("url"), F.col("text"), F.col("number"), F.col("_plain"))).drop("_plain")
    open_ = F.coalesce((F.size("evidence") == 0) & F.col("url").isNotNull() & distinctive_prefix(F.concat("_t", "_u"), F.col("_c")), F.lit(False))
    rows = kept(rows.withColumn("_open", open_), "results")  # looked at several times from here on
    # pages are looked at for those alone whose title and address don't tell
    seen = with_pages(rows.where("_open"), pages)
    shown = page_evidence(match_key("page"), F.col("_n"), F.col("_c"))
    seen = seen.withColumn("evidence", F.when(F.col("page").isNull(), F.col("evidence")).otherwise(shown))
    seen = seen.withColumn("refused", F.when(F.col("page").isNull(), "candidate_page_fetch_failed").when(F.size("evidence") == 0, "candidate_page_missing_company_name")).drop("page")
    told = rows.where("not _open").withColumn("refused", F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "insufficient_business_match"))
    return decide(kept(told.unionByName(seen).drop("_n", "_c", "_u", "_t", "_open", "text"), "told"), most)


def discover(groups: DataFrame, registry: DataFrame, results: DataFrame, pages: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Candidates (business_id, url, method, evidence, ...) and each business's status.

    Addresses in the registry, where there are any, take the place of search results.
    """
    found = registry_urls(registry)
    searched = groups.join(found.select("business_id").distinct(), "business_id", "left_anti")
    decisions = evaluate(searched, results, pages, most)
    accepted = decisions.where("decision = 'accepted'")
    status = F.lit("unverified_candidate").alias("verification_status")
    candidates = found.select("business_id", "url", F.lit("registry_field").alias("discovery_method"), F.array().cast("array<string>").alias("match_evidence"), status).union(accepted.select("business_id", "url", F.lit("search"), "evidence", status))
    n = candidates.groupBy("business_id").agg(F.count("*").alias("candidates"))
    error = F.col("error") if "error" in groups.columns else F.lit(None).cast("string")
    summary = groups.join(n, "business_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return candidates, summary.select("business_id", "candidates", website_status(F.col("candidates"), error).alias("status"))


def website_stats(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.count("*").alias("tested"), F.count_if(F.expr("candidates > 0")).alias("with_candidates"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("urls"), F.count_if(F.expr("status = 'not_found'")).alias("without"), F.count_if(F.expr("status = 'search_error'")).alias("errors"))


def checked(candidates: DataFrame) -> DataFrame:
    """candidates, if all have http(s) addresses and none counts as verified."""
    return reconcile(candidates, url=~F.coalesce(F.col("url").rlike(r"\Ahttps?://[^/]+"), F.lit(False)), status=F.col("verification_status") != "unverified_candidate")

