"""Ingredient lists as printed on labels, split into names.

Separators inside of brackets don't part names. Lists without a bracket, which most are, stay in the JVM; others
are cut by a small Arrow function. Texts may hold any characters: nothing stands in for another on the way.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow
from .text import let, trimmed

# What parts ingredients, the brackets inside of which nothing does, and the names of errors.
SEPARATORS = "、,，;；\n\r"
BRACKETS = ["()", "（）", "[]", "【】", "〔〕", "﹝﹞", "{}"]
LENIENT_SEPARATORS = "、，,"
LENIENT_BRACKETS = ["(（", ")）"]
EMPTY, UNBALANCED, BETWEEN, TRAILING = "empty_content_label", "unbalanced_ingredient_brackets", "empty_ingredient_between_separators", "trailing_ingredient_separator"

MARKS = re.compile("[" + re.escape(SEPARATORS + "".join(BRACKETS)) + "]")
CLOSER = {pair[0]: pair[1] for pair in BRACKETS}
LENIENT_MARKS = re.compile("[" + re.escape(LENIENT_SEPARATORS + "".join(LENIENT_BRACKETS)) + "]")


def parted(text: str) -> tuple[list[str], bool, bool]:
    """What stands between the separators outside of brackets, as far as brackets match; whether all do; and whether
    the text ends with an ideographic comma that parts. Ideographic commas with nothing between them are one."""
    awaited: list[str] = []
    parts: list[str] = []
    at, end, last = 0, len(text), ""
    for m in MARKS.finditer(text):
        sign = m[0]
        if sign in CLOSER:
            awaited.append(CLOSER[sign])
        elif sign in SEPARATORS:
            if awaited:
                continue
            if not (sign == last == "、" and not text[at : m.start()].strip()):
                parts.append(text[at : m.start()])
            at, last = m.end(), sign
        elif awaited and awaited[-1] == sign:
            awaited.pop()
        else:
            end = m.start()
            break
    parts.append(text[at:end])
    return parts, end == len(text) and not awaited, last == "、" and not parts[-1].strip()


def leniently_parted(text: str) -> list[str]:
    """What stands between commas outside of round brackets of either width; too many closing ones don't count."""
    opening, closing = LENIENT_BRACKETS
    depth, at, parts = 0, 0, []
    for m in LENIENT_MARKS.finditer(text):
        if m[0] not in LENIENT_SEPARATORS:
            depth = depth + 1 if m[0] in opening else max(depth - 1, 0)
        elif not depth:
            parts.append(text[at : m.start()])
            at = m.end()
    return [*parts, text[at:]]


@arrow("parts array<string>, whole boolean, ends boolean")
def _parted(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if t is None else parted(t) for t in texts], columns=["parts", "whole", "ends"])


@arrow("array<string>")
def _leniently_parted(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else leniently_parted(t) for t in texts], dtype=object)


def _class(signs: str) -> str:
    return "[" + re.escape(signs) + "]"


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def split_strict(text: Column | str) -> Column:
    """{names, error}: brackets must match in kind and nest, and no separator may stand without a name.

    Only the ideographic comma may be doubled after a name, or stand at the end. The first error in order
    of the text counts, and there are no names beside it.
    """
    text = _text(text)
    cut = _parted(F.when(text.rlike(_class("".join(BRACKETS))), text))
    # doubled ideographic commas are one; what a name is made of can't be blank
    once = F.regexp_replace(text, r"(?U)、(?:[\s\x1c-\x1f&&[^\n\r]]*、)+", "、")
    read = F.struct((trimmed(text) == "").alias("blank"), cut.alias("cut"), F.when(cut["parts"].isNull(), once).alias("once"))
    no_names = F.array().cast("array<string>")

    def parts_of(m: Column) -> Column:
        ends = F.coalesce(m["cut"]["ends"], trimmed(F.regexp_replace(m["once"], r"[\n\r]", "\u0001")).endswith("、"))
        parts = F.coalesce(m["cut"]["parts"], F.split(m["once"], _class(SEPARATORS)))
        return F.struct(m["blank"].alias("blank"), F.coalesce(m["cut"]["whole"], F.lit(True)).alias("whole"), ends.alias("ends"), F.transform(parts, trimmed).alias("parts"))

    def judged(m: Column) -> Column:
        before, last = F.slice(m["parts"], 1, F.size(m["parts"]) - 1), F.element_at(m["parts"], -1)
        error = F.when(m["blank"], EMPTY).when(F.array_contains(before, ""), BETWEEN).when(~m["whole"], UNBALANCED).when((last == "") & ~m["ends"], TRAILING)
        return F.struct(F.when(last == "", before).otherwise(m["parts"]).alias("names"), error.alias("error"))

    def told(m: Column) -> Column:
        return F.struct(F.when(m["error"].isNull(), m["names"]).otherwise(no_names).alias("names"), m["error"].alias("error"))

    # each step is computed once, however often the next one refers to it
    return let(let(let(read, parts_of), judged), told)


def split_lenient(text: Column | str) -> Column:
    """Names between commas outside of round brackets; blanks are dropped, nothing is an error."""
    text = _text(text)
    cut = _leniently_parted(F.when(text.rlike(_class("".join(LENIENT_BRACKETS))), text))
    parts = F.coalesce(cut, F.split(text, _class(LENIENT_SEPARATORS)))
    return F.filter(F.transform(parts, trimmed), lambda n: n != "")
