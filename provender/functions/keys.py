"""Keys that names are compared by, identifiers made of them, and the likeness of names."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow
from .text import clean

#: What a key keeps: ASCII letters and digits, and CJK ideographs.
DROPPED = re.compile(r"[^0-9a-z㐀-鿿]+")
# Fixed value: the name space of identifiers made of trace codes.
ID_PREFIX = "tfda-traceability"


def _each(values: pd.Series, f) -> pd.Series:
    return pd.Series([None if v is None else f(v) for v in values], dtype=object)


def folded(value: str) -> str:
    return DROPPED.sub("", value.casefold())


@arrow("string")
def name_key(names: pd.Series) -> pd.Series:
    """Case folded; letters, digits and ideographs alone."""
    return _each(names, folded)


def matched(value: str) -> str:
    return DROPPED.sub("", unicodedata.normalize("NFKC", unquote(value)).casefold())


@arrow("string")
def match_key(names: pd.Series) -> pd.Series:
    """As name_key, after percent decoding and compatibility normalisation."""
    return _each(names, matched)


@arrow("string")
def case_folded(names: pd.Series) -> pd.Series:
    return _each(names, str.casefold)


def slug(value: str) -> str:
    words = re.findall(r"[0-9a-z㐀-鿿]+", unicodedata.normalize("NFKC", value).casefold())
    return "-".join(words) or "product"


@arrow("string")
def slugged(names: pd.Series) -> pd.Series:
    """Words joined by hyphens; ``product`` if none is left."""
    return _each(names, slug)


@arrow("string")
def source_id(urls: pd.Series) -> pd.Series:
    """The registrable label of an address's host, as a slug."""

    def label(url: str) -> str:
        host = (urlsplit(url).hostname or "").lower().split(".")
        at = 3 if len(host) > 2 and host[-1] == "tw" and host[-2] in ("com", "org", "net") else min(2, len(host))
        return slug(host[-at])

    return _each(urls, label)


def product_id(brand: Column, name: Column, specification: Column, barcode: Column) -> Column:
    """A formal product's identifier: the slug of its parts that aren't blank."""
    return slugged(F.concat_ws("-", *(F.when(c != "", c) for c in (brand, name, specification, barcode))))


def candidate_id(trace_code: Column, *identity: Column, prefix: str = ID_PREFIX) -> Column:
    """An identifier from the safe characters of a trace code, or from a hash of company, product and package."""
    safe = F.regexp_replace(F.regexp_replace(clean(trace_code), r"[^A-Za-z0-9._-]+", "-"), r"\A-+|-+\z", "")
    hashed = F.substring(F.sha2(F.concat_ws("\x1f", *map(clean, identity)), 256), 1, 20)
    return F.when(safe != "", F.concat(F.lit(f"{prefix}:"), safe)).otherwise(F.concat(F.lit(f"{prefix}:missing:"), hashed))


@arrow("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much two names have in common in order (Ratcliff and Obershelp), by their keys, to four places; 0 if one is empty."""

    def ratio(x: str | None, y: str | None) -> float:
        x, y = (DROPPED.sub("", (v or "").casefold()) for v in (x, y))
        return round(SequenceMatcher(None, x, y).ratio(), 4) if x and y else 0.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")
