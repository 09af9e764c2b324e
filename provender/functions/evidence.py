"""Evidence that a web page belongs to a business."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow
from .keys import match_key, matched
from .text import clean
from .urls import candidate_url, parts_of, redirect_target, unquoted, url_parts

# Legal forms at the end of a name; registry fields that hold addresses.
LEGAL_FORMS = r"(?:股份有限公司|有限公司|有限合夥)\n?\z"
URL_FIELDS = r"(?i)(?:網站|網址|官網|website|url|homepage)"
URL_VALUES = r"(?i)(https?://[^\s<>\"']+)"


def core_name(name: Column) -> Column:
    return F.regexp_replace(name, LEGAL_FORMS, "")


@arrow("decoded_url string, valid boolean, host string, url string, plain string, url_key string, text_key string")
def result_read(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """What search results are judged by, read once: ``decode_redirect`` of the address, ``url_parts`` of that, the normal
    form without percent signs, and the keys of it and of the text."""
    rows = []
    for raw, text in zip(urls, texts):
        decoded = redirect_target(raw)
        valid, host, url = parts_of(decoded)
        rows.append((decoded, valid, host, url, url and unquote(url), url and matched(url), None if text is None else matched(text)))
    return pd.DataFrame(rows, columns=["decoded_url", "valid", "host", "url", "plain", "url_key", "text_key"])


def match_evidence(url_key: Column, text_key: Column, name_key: Column, core_key: Column, url: Column, text: Column, number: Column, plain: Column | None = None) -> Column:
    """full_name or else core_name (three characters or more), and unified_number; the keys are match_key()s, plain the address without percent signs where it is known."""
    def inside(key: Column) -> Column:
        return (key != "") & (F.contains(text_key, key) | F.contains(url_key, key))

    name = F.when(inside(name_key), "full_name").when((F.char_length(core_key) >= 3) & inside(core_key), "core_name")
    digits = F.when((F.coalesce(number, F.lit("")) != "") & (F.contains(text, number) | F.contains(unquoted(url) if plain is None else plain, number)), "unified_number")
    return F.array_compact(F.array(name, digits))


def distinctive_prefix(both_key: Column, core_key: Column) -> Column:
    """Whether the first two characters of a core of four or more stand in the text and address."""
    return (F.char_length(core_key) >= 4) & F.contains(both_key, F.substring(core_key, 1, 2))


def page_evidence(page_key: Column, name_key: Column, core_key: Column) -> Column:
    return F.when((name_key != "") & F.contains(page_key, name_key), F.array(F.lit("full_name_in_page"))).when((F.char_length(core_key) >= 3) & F.contains(page_key, core_key), F.array(F.lit("core_name_in_page"))).otherwise(F.array().cast("array<string>"))


def number_status(number: Column) -> Column:
    """missing, valid (eight digits) or invalid."""
    return F.when(clean(number) == "", "missing").when(clean(number).rlike(r"(?U)\A\d{8}\z"), "valid").otherwise("invalid")


def field_urls(record: Column) -> Column:
    """Addresses in those fields of a record (a map) whose names speak of web sites, in order, as {field, raw}."""
    fields = F.filter(F.map_entries(record), lambda e: e["key"].rlike(URL_FIELDS) & e["value"].isNotNull())
    found = F.transform(fields, lambda e: F.transform(F.regexp_extract_all(e["value"], F.lit(URL_VALUES), F.lit(1)), lambda u: F.struct(e["key"].alias("field"), F.regexp_replace(u, r"[.,;，。；)）]+\z", "").alias("raw"))))
    return F.flatten(found)


def own_url(url: Column) -> Column:
    """The normal form of an address that could be a business's own."""
    return candidate_url(url_parts(url))


__all__ = ["core_name", "distinctive_prefix", "field_urls", "match_evidence", "match_key", "number_status", "own_url", "page_evidence", "result_read"]
