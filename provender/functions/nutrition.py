"""Nutrients, quantities parsed from label text, and daily references."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow
from .text import filled, non_negative, number_of, raised

# Nutrient, unit, daily reference (null: none).
NUTRIENTS = [
    ("calories", "kcal", 2000.0),
    ("protein", "g", 60.0),
    ("fat", "g", 60.0),
    ("saturatedFat", "g", 18.0),
    ("transFat", "g", None),
    ("carbohydrates", "g", 300.0),
    ("sugar", "g", None),
    ("sodium", "mg", 2000.0),
]
NAMES = [name for name, _, _ in NUTRIENTS]
UNITS = {name: unit for name, unit, _ in NUTRIENTS}
# Spellings of units on labels.
VOLUME_UNITS = {"公克": "g", "克": "g", "g": "g", "毫升": "ml", "ml": "ml"}
NUTRIENT_UNITS = {"大卡": "kcal", "千卡": "kcal", "kcal": "kcal", "公克": "g", "克": "g", "g": "g", "毫克": "mg", "mg": "mg"}
NUMERAL = r"((?:0|[1-9]\d*)(?:\.\d+)?)"
NUTRITION_TYPE = "struct<" + ",".join(f"{n}:struct<value:double,unit:string>" for n in NAMES) + ">"
STALE_DAYS = 180


def _amount(text: Column, units: dict[str, str], wanted: str | None = None) -> Column:
    """{raw, value, unit} of a text that is nothing but a number and a unit; value and unit are null
    for any other, or if the canonical unit isn't the one wanted."""
    value = unit = F.lit(None)
    # a pattern for each canonical unit: what it finds has that unit, whatever its spelling, so no spelling is looked up row by row
    for u in [wanted] if wanted else dict.fromkeys(units.values()):
        names = "|".join(sorted((name for name, canonical in units.items() if canonical == u), key=len, reverse=True))
        found = F.regexp_extract(text, rf"(?iU)\A\s*{NUMERAL}\s*(?:{names})\s*\z", 1)
        value, unit = F.when(found != "", number_of(found)).otherwise(value), F.when(found != "", u).otherwise(unit)
    return F.struct(F.coalesce(text, F.lit("")).alias("raw"), value.cast("double").alias("value"), unit.cast("string").alias("unit"))


def quantity(text: Column) -> Column:
    """{raw, value, unit} of a serving size such as ``12.5公克``; raw is '' for null."""
    return _amount(text, VOLUME_UNITS)


def nutrient(text: Column, unit: str) -> Column:
    """{raw, value, unit} of a nutrient's amount, null unless it is given in ``unit``."""
    return _amount(text, NUTRIENT_UNITS, unit)


def zero_package(text: Column) -> Column:
    """Whether a package size begins with no quantity at all, as ``0公克/包``."""
    names = "|".join(sorted(VOLUME_UNITS, key=len, reverse=True))
    return F.coalesce(text.rlike(rf"(?iU)\A\s*0(?:\.0+)?\s*(?:{names})(?:\s*/|\s*\z)"), F.lit(False))


def anomalies(package: Column, nutrition: Column, names: list[str] = NAMES) -> Column:
    """What is wrong with a label: a package of nothing, then amounts that say something unreadable."""
    found = {"zero_package_quantity": zero_package(package)} | {f"unparsed_nutrition:{n}": (nutrition[n]["raw"] != "") & nutrition[n]["value"].isNull() for n in names}
    return raised(list(found.values()), list(found))


def complete(nutrition: Column, names: list[str] = NAMES) -> Column:
    """All nutrients have a number and a unit; the sign isn't looked at."""
    return reduce(and_, (F.coalesce(nutrition[n]["value"].isNotNull() & filled(nutrition[n]["unit"]), F.lit(False)) for n in names))


def complete_non_negative(nutrition: Column, names: list[str] = NAMES) -> Column:
    return reduce(and_, (valid_amount(nutrition[n]) for n in names))


def valid_amount(amount: Column, value: str = "value") -> Column:
    """A quantity with a number of at least 0 and a unit."""
    return F.coalesce(F.coalesce(amount[value] >= 0, F.lit(False)) & ~F.isnan(amount[value].cast("double")) & filled(amount["unit"]), F.lit(False))


def long_form(nutrition: str, *keep: str) -> list[Column]:
    """Columns of one row for each nutrient: keep, nutrient, value, unit."""
    rows = F.array(*(F.struct(F.lit(n).alias("nutrient"), F.col(nutrition)[n]["value"].alias("value"), F.col(nutrition)[n]["unit"].alias("unit")) for n in NAMES))
    return [*map(F.col, keep), F.inline(rows)]


def unit_of(nutrient: Column) -> Column:
    return F.create_map(*(F.lit(x) for n, u, _ in NUTRIENTS for x in (n, u)))[nutrient]


def reference_of(nutrient: Column) -> Column:
    return F.create_map(*(F.lit(x) for n, _, r in NUTRIENTS if r for x in (n, r)))[nutrient]


def daily_pct(value: Column, unit: Column, reference: Column, reference_unit: Column) -> Column:
    """Share of the daily reference in percent; null unless value and units allow one."""
    return F.when(non_negative(value) & (unit == reference_unit) & (reference > 0), value / reference * 100)


def progress(pct: Column) -> Column:
    return F.when(pct.isNotNull(), F.least(F.greatest(pct, F.lit(0.0)), F.lit(100.0)))


def one_decimal(x: Column) -> Column:
    """One decimal of the exact binary value, ties up: only multiples of a quarter can be ties."""
    exact = F.regexp_replace(F.format_number(x, 1), ",", "").cast("double")
    return F.when(x * 4 == F.floor(x * 4), F.round(x, 1)).otherwise(exact)


def pct_label(pct: Column) -> Column:
    shown = one_decimal(pct)
    return F.when(pct.isNotNull(), F.concat(numeral(shown), F.lit("%")))


def numeral(x: Column) -> Column:
    """A number as people write it: whole ones without a decimal part."""
    x = x.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def reference_status(pct: Column) -> Column:
    """reached, near or normal, by the unrounded share."""
    return F.when(pct >= 100, "reached").when(pct >= 80, "near").when(pct >= 0, "normal")


def calendar_date(text: Column) -> Column:
    """A strict YYYY-MM-DD date; years from 1 on, no roll-over."""
    return F.when(text.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def freshness(verified_at: Column, as_of: Column) -> Column:
    """{elapsed_days, is_stale} of a date as of a day; null if it is no date or lies ahead."""
    days = F.datediff(as_of, calendar_date(verified_at))
    return F.when(days >= 0, F.struct(days.alias("elapsed_days"), (days > STALE_DAYS).alias("is_stale")))


@arrow("double")
def precision15(x: pd.Series) -> pd.Series:
    """Fifteen significant digits, which takes the noise of binary sums away."""
    return x.map(lambda v: None if v is None or v != v else float(f"{v:.15g}")).astype("float64")


def label_nutrition(text: Column) -> Column:
    """{serving, nutrition, error} of a label's text block.

    The first ``每一份量 N 毫升`` or ``公克`` is the serving; a line that begins with a nutrient's name,
    a numeral and a unit gives that nutrient, a later one over an earlier; units stay as given. A
    numeral that is none, as ``1.2.3``, makes the block an error.
    """
    # Names and units on the retail labels.
    names = {"熱量": "calories", "蛋白質": "protein", "脂肪": "fat", "飽和脂肪": "saturatedFat", "反式脂肪": "transFat", "碳水化合物": "carbohydrates", "糖": "sugar", "鈉": "sodium"}
    units = {"大卡": "kcal", "公克": "g", "毫克": "mg"}
    unit = F.create_map(*(F.lit(x) for pair in [*units.items(), ("毫升", "ml")] for x in pair))
    serving = r"(?U)每一份量\s*(\d+(?:\.\d+)?)\s*(毫升|公克)"
    size = F.when(text.rlike(serving), F.struct(number_of(F.regexp_extract(text, serving, 1)).alias("amount"), unit[F.regexp_extract(text, serving, 2)].alias("unit")))
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\A\s+", ""))
    amounts, bad = [], []

    def one(label: str, name: str) -> None:
        pattern = rf"(?U)\A{label}\s*([0-9.]+)\s*(大卡|公克|毫克)"
        found = F.filter(lines, lambda x: x.rlike(pattern))
        last = F.get(found, F.size(found) - 1)
        amounts.append(F.when(last.isNotNull(), F.struct(F.regexp_extract(last, pattern, 1).try_cast("double").alias("value"), unit[F.regexp_extract(last, pattern, 2)].alias("unit"))).alias(name))
        bad.append(F.exists(found, lambda x: F.regexp_extract(x, pattern, 1).try_cast("double").isNull()))

    for label, name in names.items():
        one(label, name)
    error = F.when(reduce(lambda a, b: a | b, bad), F.lit("invalid_numeral"))
    return F.struct(size.alias("serving"), F.struct(*amounts).alias("nutrition"), error.alias("error"))


def serving_text(text: Column) -> Column:
    """{amount, unit, text} of a serving size in digits and letters; only text if it is anything else."""
    pattern = r"(?U)\A\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*\z"
    found = text.rlike(pattern)
    return F.struct(F.when(found, number_of(F.regexp_extract(text, pattern, 1))).alias("amount"), F.when(found, F.regexp_extract(text, pattern, 2)).alias("unit"), F.when(F.coalesce(text, F.lit("")) != "", text).alias("text"))
