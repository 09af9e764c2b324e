"""Products validated as a catalogue loads them, and the gates before promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions.nutrition import NAMES, UNITS, calendar_date
from provender.functions.text import clean, filled, has_display_value, script_trimmed
from provender.sources.shared import computed

from .schema import kind_is, number_in, text_in

TEXTS = ["brand", "manufacturer", "barcode", "traceabilityCode"]
WARNING = "array<struct<field:string,reason:string>>"


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    """The trimmed text of a VARIANT; null unless it says something."""
    t = text_in(v)
    return F.when(has_display_value(t), script_trimmed(t))


def _warn(bad: Column, field: Column | str, reason: str) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(field.alias("field"), F.lit(reason).alias("reason")))


def _amount(v: Column, value: str, unit: str | None = None) -> Column:
    """{value, unit} of a quantity of at least 0; an expected unit is compared before trimming."""
    n, u = number_in(v, f"$.{value}"), text_in(v, "$.unit")
    good = (n >= 0) & ~F.isnan(n) & (n < F.lit(float("inf"))) & has_display_value(u)
    if unit:
        good &= u == unit
    return F.when(F.coalesce(kind_is(v, "object") & good, F.lit(False)), F.struct(n.alias(value), script_trimmed(u).alias("unit")))


def _sources(v: Column) -> tuple[Column, Column]:
    """Valid sources, the first of each id, and warnings. An id is taken even by a source that isn't valid."""
    items = F.when(kind_is(v, "array"), F.try_variant_get(v, "$", "array<variant>"))
    read = F.transform(items, lambda s, i: F.struct(i.alias("i"), _text(_field(s, "id")).alias("id"), _text(_field(s, "name")).alias("name"), _text(_field(s, "url")).alias("url"), _field(s, "verified_at").isNotNull().alias("dated"), text_in(s, "$.verified_at").alias("verified_at"), kind_is(s, "object").alias("object")))
    ids = F.transform(read, lambda s: s["id"])
    read = F.transform(read, lambda s: s.withField("again", s["id"].isNotNull() & (F.array_position(ids, s["id"]) < s["i"] + 1)))
    link = lambda s: F.coalesce(F.lower(s["url"]).rlike(r"\Ahttps?:/*[^/\s]"), F.lit(False))
    good = F.filter(read, lambda s: s["object"] & ~s["again"] & s["id"].isNotNull() & s["name"].isNotNull() & link(s))
    kept = F.transform(good, lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["url"].alias("url"), F.when(calendar_date(s["verified_at"]).isNotNull(), s["verified_at"]).alias("verified_at")))

    def of(s: Column) -> Column:
        at = F.concat(F.lit("sources["), s["i"].cast("string"), F.lit("]"))
        named = s["object"] & ~s["again"]
        whole = named & s["id"].isNotNull() & s["name"].isNotNull() & s["url"].isNotNull()
        return F.array_compact(F.array(
            _warn(~s["object"], at, "not an object"),
            _warn(s["again"], at, "duplicate id"),
            *(_warn(named & s[k].isNull(), at, f"{k} missing") for k in ("id", "name", "url")),
            _warn(whole & link(s) & s["dated"] & calendar_date(s["verified_at"]).isNull(), at, "verified_at invalid"),
            _warn(whole & ~link(s), at, "url invalid"),
        ))

    none = F.array().cast("array<struct<id:string,name:string,url:string,verified_at:string>>")
    return F.coalesce(kept, none), F.coalesce(F.flatten(F.transform(read, of)), F.array(F.struct(F.lit("sources").alias("field"), F.lit("missing or not an array").alias("reason"))))


def refers_to_source(sources: Column, source_id: Column) -> Column:
    """Whether a product's nutrition source is one of its sources."""
    return F.coalesce(F.exists(sources, lambda s: s["id"] == script_trimmed(source_id)) & has_display_value(source_id), F.lit(False))


def checked_products(rows: DataFrame, record: str = "record") -> DataFrame:
    """Every VARIANT row once, with ``kept``, the fields of a product (null unless kept) and ``warnings``.

    A row needs an object with id and name. Of rows with the same id the first alone is looked at:
    it takes the id even if it lacks a name. Other fields that aren't valid become null with a
    warning; absent texts are null without one. ``other`` is the record as it came, for the fields
    that aren't validated. Only ids and positions are grouped; records aren't moved for it unless
    the join with the first positions asks for it.
    """
    v = F.col(record)
    rows = computed(rows.withColumn("_id", F.when(F.coalesce(kind_is(v, "object"), F.lit(False)), _text(_field(v, "id")))))
    named = rows.where("_id is not null").groupBy("_id").agg(F.min("_pos").alias("_p"))
    read = rows.join(named, "_id", "left").select("_pos", v.alias("other"), F.coalesce(kind_is(v, "object"), F.lit(False)).alias("object"), F.col("_id").alias("id"), _text(_field(v, "name")).alias("name"), F.coalesce(F.col("_pos") == F.col("_p"), F.lit(False)).alias("first"), *(_field(v, t).alias(f"raw_{t}") for t in (*TEXTS, "serving", "nutrition", "sources", "nutritionSource")))
    texts = {t: _text(F.col(f"raw_{t}")) for t in TEXTS}
    texts["barcode"] = F.when(texts["barcode"].rlike(r"\A[0-9]+\z"), texts["barcode"])
    sources, source_warnings = _sources(F.col("raw_sources"))
    out = computed(read).withColumn("kept", F.col("first") & F.col("name").isNotNull()).withColumn("_s", F.struct(sources.alias("sources"), source_warnings.alias("warnings")))
    refers = _text(F.col("raw_nutritionSource"))
    nutrition = F.struct(*(_amount(_field(F.col("raw_nutrition"), n), "value", UNITS[n]).alias(n) for n in NAMES))
    is_object = F.coalesce(kind_is(F.col("raw_nutrition"), "object"), F.lit(False))
    out = computed(out).select("*", *(c.alias(t) for t, c in texts.items()), _amount(F.col("raw_serving"), "amount").alias("serving"), nutrition.alias("nutrition"), F.when(refers_to_source(F.col("_s.sources"), refers), refers).alias("nutritionSource"))
    out = computed(out)
    found = [_warn(F.col(f"raw_{t}").isNotNull() & _text(F.col(f"raw_{t}")).isNull(), t, "missing or not a text") for t in TEXTS]
    found += [_warn(_text(F.col("raw_barcode")).isNotNull() & F.col("barcode").isNull(), "barcode", "not digits"), _warn(F.col("serving").isNull(), "serving", "not a quantity"), _warn(~is_object, "nutrition", "missing or not an object")]
    found += [_warn(is_object & F.col("nutrition")[n].isNull(), f"nutrition.{n}", "not a quantity") for n in NAMES]
    found += [_warn(refers.isNull(), "nutritionSource", "missing or not a text"), _warn(refers.isNotNull() & F.col("nutritionSource").isNull(), "nutritionSource", "no such source")]
    lost = F.array_compact(F.array(
        _warn(~F.col("object"), "product", "not an object"),
        _warn(F.col("object") & F.col("id").isNull(), "id", "missing or not a text"),
        _warn(F.col("object") & F.col("name").isNull(), "name", "missing or not a text"),
        _warn(F.col("id").isNotNull() & ~F.col("first"), "id", "duplicate id"),
    ))
    warnings = F.concat(lost, F.when(F.col("kept"), F.concat(F.array_compact(F.array(*found)), F.col("_s.warnings"))).otherwise(F.array().cast(WARNING)))
    fields = {"id": F.col("id"), "name": F.col("name"), **{t: F.col(t) for t in TEXTS}, "serving": F.col("serving"), "nutrition": F.col("nutrition"), "sources": F.col("_s.sources"), "nutritionSource": F.col("nutritionSource"), "other": F.col("other")}
    return out.select("_pos", "kept", *(F.when(F.col("kept"), c).alias(n) for n, c in fields.items()), warnings.alias("warnings"))


def load_validate(rows: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Clean products (_pos, id, name, ..., other) and warnings (_pos, field, reason): the two halves of checked_products."""
    checked = checked_products(rows, record)
    return checked.where("kept").drop("kept", "warnings"), checked.select("_pos", F.explode("warnings").alias("w")).select("_pos", "w.*")


def retail_gate(complete: Column) -> Column:
    """The first thing that keeps a retail candidate from promotion; null if nothing does.

    complete: whether all nutrients have a number of at least 0 and a unit. Columns: source_url,
    source_name, matched_name, brand, barcode, serving, ingredients (array<string>), generated_at.
    """
    amount = F.col("serving.amount")
    return F.coalesce(
        F.when(~filled(F.col("source_url")), "source_url missing"),
        F.when(~filled(F.col("source_name")), "source_name missing"),
        F.when(~filled(F.col("matched_name")), "matched_name missing"),
        F.when(~filled(F.col("brand")), "brand missing"),
        F.when(~clean(F.col("barcode")).rlike(r"(?U)\A\d+\z"), "barcode not digits"),
        F.when(~F.coalesce((amount >= 0) & ~F.isnan(amount) & filled(F.col("serving.unit")), F.lit(False)), "serving not convertible"),
        F.when(F.col("ingredients").isNull() | F.exists("ingredients", lambda i: ~filled(i)), "ingredient without a name"),
        F.when(calendar_date(F.substring_index("generated_at", "T", 1)).isNull(), "generated_at not a date"),
        F.when(~complete, "nutrition incomplete"),
    )


def select_unique(df: DataFrame, condition: Column) -> DataFrame:
    """The one row that meets a condition; none or several are an error with their number."""
    found = df.where(condition)
    n = found.count()
    if n != 1:
        raise ValueError(f"{n} rows where one is needed")
    return found


def catalogue_faults(products: DataFrame) -> DataFrame:
    """(column, value, n): blank ids, and ids and trace codes that stand there more than once."""
    ids = products.groupBy(clean(F.col("id")).alias("value")).agg(F.count("*").alias("n")).where("n > 1 or value = ''").select(F.lit("id").alias("column"), "value", "n")
    codes = products.where(filled(F.col("traceabilityCode"))).groupBy(clean(F.col("traceabilityCode")).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    return ids.union(codes.select(F.lit("traceabilityCode"), "value", "n"))
