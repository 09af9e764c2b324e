"""Text columns: trimming, blanks and sentinels, digits of any script."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the two kinds of trimming remove at both ends of a text.
UNICODE_SPACE = r"[\s\x1c-\x1f]"
SCRIPT_SPACE = r"[[\s\x{FEFF}]&&[^\x{85}\x1c-\x1f]]"
#: Texts that stand for nothing in a product catalogue.
SENTINELS = ("undefined", "null", "nan")
FULL_WIDTH = "０１２３４５６７８９"


def trimmed(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, rf"(?U)\A{UNICODE_SPACE}+|{UNICODE_SPACE}+\z", "")


def script_trimmed(c: Column) -> Column:
    """As a browser trims: the byte order mark counts as white space, control separators don't."""
    return F.regexp_replace(c, rf"(?U)\A{SCRIPT_SPACE}+|{SCRIPT_SPACE}+\z", "")


def clean(c: Column) -> Column:
    """Trimmed text; null gives the empty text."""
    return trimmed(F.coalesce(c, F.lit("")))


def filled(c: Column) -> Column:
    """Whether there is text besides white space; as a rule its first character tells."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def has_display_value(c: Column) -> Column:
    """Whether a text is neither blank nor a sentinel in any case."""
    return F.coalesce((script_trimmed(c) != "") & ~F.lower(script_trimmed(c)).isin(*SENTINELS), F.lit(False))


def finite(c: Column) -> Column:
    c = c.cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def non_negative(c: Column) -> Column:
    """A finite number of at least 0; Spark puts NaN above all numbers, so that is ruled out first."""
    return finite(c) & F.coalesce(c >= 0, F.lit(False))


def number_of(c: Column) -> Column:
    """A plain numeral, full-width digits included, as a double."""
    return F.translate(c, FULL_WIDTH, "0123456789").try_cast("double")


def without_white_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def single_spaced(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def plain_key(c: Column) -> Column:
    """Markup and white space gone, in lower case."""
    return F.lower(without_white_space(F.regexp_replace(c, r"<[^>]+>", "")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once; large expressions stay small that way."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def raised(flags: list[Column], names: list[str]) -> Column:
    """The names whose flags are up, in order. Blanks are removed, not nulls, as that needs no function of values, which isn't compiled."""
    return F.array_remove(F.array(*(F.when(flag, F.lit(name)).otherwise("") for flag, name in zip(flags, names))), "")
