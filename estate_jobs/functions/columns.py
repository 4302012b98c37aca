"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estate_jobs.functions.params import INDUSTRIAL_ZONES

#: White space of listing texts: Java's \s lacks the no-break kinds.
S = r"[\s\x{00A0}\x{202F}\x{2009}]"


def rnd(x: Column, n: int) -> Column:
    """Rounded half up in decimal, then a double again."""
    return F.round(x.cast("decimal(28,10)"), n).cast("double")


def nz(x: Column, *missing) -> Column:
    """x, or null where it is one of its spellings of `missing`."""
    for m in missing:
        x = F.nullif(x, F.lit(m))
    return x


def first_match(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that the text contains; else null."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words))


def any_match(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(first_match(text, words).isNotNull(), F.lit(False))


def place_key(district: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(district, F.lit("")), r"^\s+|\s+$", ""))


def zone(district: Column) -> Column:
    return F.coalesce(first_match(place_key(district), INDUSTRIAL_ZONES), F.lit(""))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere of 6,371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(6371000.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
