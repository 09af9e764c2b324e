"""What a product page shows: summaries, quantities, sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nutrition import numeral
from .text import has_display_value, non_negative, script_trimmed

# Words of the pages.
MISSING = "目前尚無資料"
LABELS = {"brand": "品牌：", "manufacturer": "製造業者：", "barcode": "條碼：", "trace": "食品追溯碼："}


def shown(c: Column) -> Column:
    return F.when(has_display_value(c), c.cast("string")).otherwise(F.lit(MISSING))


def summary(brand: Column, manufacturer: Column, barcode: Column, trace_code: Column) -> Column:
    """Brand or else manufacturer, barcode or else trace code; what is missing is left out."""
    def labelled(name: str, c: Column) -> Column:
        return F.when(has_display_value(c), F.concat(F.lit(LABELS[name]), c))

    return F.concat_ws(" · ", F.coalesce(labelled("brand", brand), labelled("manufacturer", manufacturer)), F.coalesce(labelled("barcode", barcode), labelled("trace", trace_code)))


def suggestion(brand: Column, barcode: Column) -> Column:
    return F.concat_ws(" · ", shown(brand), shown(barcode))


def quantity_label(value: Column, unit: Column, separator: str = " ") -> Column:
    good = non_negative(value) & has_display_value(unit)
    return F.when(good, F.concat(numeral(value), F.lit(separator), unit)).otherwise(F.lit(MISSING))


def ratio_label(value: Column, unit: Column) -> Column:
    """A share of the product, with no space before a per cent sign; null if there is none."""
    bare = script_trimmed(unit)
    return F.when(non_negative(value) & has_display_value(unit), F.concat(numeral(value), F.when(bare.isin("%", "％"), "").otherwise(" "), bare))


def resolve_source(sources: Column, source_id: Column) -> Column:
    """The first source with that id; null if there is none, also for a blank id."""
    return F.when(has_display_value(source_id), F.get(F.filter(sources, lambda s: s["id"] == script_trimmed(source_id)), F.lit(0)))


def ingredient_sources(ingredients: Column, sources: Column) -> Column:
    """The sources that named ingredients refer to, in the order of first use, with http(s) addresses alone."""
    named = F.filter(ingredients, lambda i: has_display_value(i["name"]) & has_display_value(i["sourceId"]))
    ids = F.array_distinct(F.transform(named, lambda i: script_trimmed(i["sourceId"])))
    found = F.transform(ids, lambda x: F.get(F.filter(sources, lambda s: s["id"] == x), F.lit(0)))
    return F.filter(found, lambda s: s.isNotNull() & has_display_value(s["name"]) & F.lower(script_trimmed(s["url"])).rlike(r"\Ahttps?://[^/]"))
