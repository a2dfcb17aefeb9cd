"""Distance units: conversion, spelling and what a user's text asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import KM_PER_MILE, KM_PER_NAUTICAL_MILE, let

# Spellings of units, as users write them and as answers carry them.
CONVERT_KM = ("km", "kilometer", "kilometers", "kilometre", "kilometres", "klick", "klicks", "click", "clicks", "k", "kms", "km.", "k.")
CONVERT_NMI = ("nautical miles", "nautical mile", "nmi", "nm", "n.m.", "n mi", "sea mile", "sea miles")
CONVERT_MI = ("miles", "mi", "mile", "sm", "m", "m.", "statute", "statute miles", "give it to me in m")
ANSWER_KM = ("km", "kms", "k", "kilometer", "kilometers", "kilometre", "kilometres", "km.", "klick", "klicks", "click", "clicks")
ANSWER_MI = ("mi", "mile", "miles", "statute", "statute miles", "sm")
ANSWER_NMI = ("nmi", "nm", "n.m.", "nautical", "nauticalmile", "nauticalmiles", "sea", "sea mile", "sea miles", "seamile", "seamiles")

STRIP = r"(?U)^\s+|\s+$"
COMPACT = r"(?U)[\s.\-_/]+"


def contains_any(text: Column, needles) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def canonical_unit(unit: Column) -> Column:
    """km, mi or nmi; km for what isn't known."""
    return let(F.lower(F.coalesce(unit, F.lit(""))), lambda u: F.when(u.isin(*CONVERT_KM), "km").when(u.isin(*CONVERT_NMI), "nmi").when(u.isin(*CONVERT_MI), "mi").otherwise("km"))


def convert_km(km: Column, unit: Column) -> Column:
    """Struct value, unit: a distance in the unit that a spelling names."""
    return let(canonical_unit(unit), lambda c: F.struct(F.when(c == "mi", km / KM_PER_MILE).when(c == "nmi", km / KM_PER_NAUTICAL_MILE).otherwise(km).alias("value"), c.alias("unit")))


def to_km(value: Column, unit: Column) -> Column:
    return F.when(unit == "mi", value * KM_PER_MILE).when(unit == "nmi", value * KM_PER_NAUTICAL_MILE).otherwise(value)


def _spelled(text: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a struct s, c: a spelling in lower case without the space around it, and without any space or mark in it."""
    both = lambda s: let(F.struct(s.alias("s"), F.regexp_replace(s, COMPACT, "").alias("c")), body)
    return let(F.lower(F.regexp_replace(text, STRIP, "")), both)


def normalize_unit(token: Column) -> Column:
    """km, mi or nmi for a unit word of an answer, null for any other."""

    def named(t: Column) -> Column:
        s, c = t.s, t.c
        either = lambda words: s.isin(*words) | c.isin(*words)
        return F.when(either(ANSWER_KM), "km").when(either(ANSWER_MI) | F.contains(s, F.lit("statute")), "mi").when(either(ANSWER_NMI) | F.contains(s, F.lit("sea")), "nmi")

    return F.when(F.coalesce(token, F.lit("")) != "", _spelled(token, named))


def normalize_user_unit(raw: Column) -> Column:
    """km, mi or nmi guessed from a user's spelling, null if there is none or it isn't known."""

    def named(t: Column) -> Column:
        s, c = t.s, t.c
        has = lambda col, *words: contains_any(col, words)
        return (
            F.when(has(c, "seamile") | has(s, "sea mile"), "nmi")
            .when(has(s, "naut") | has(c, "nmi") | (c == "nm"), "nmi")
            .when(has(s, "statute") | has(c, "statutemile"), "mi")
            .when(has(s, "mile") | s.rlike(r"(?U)\bmi\b") | c.isin("m", "sm"), "mi")
            .when(has(c, "km") | has(s, "klick", "click") | (c == "k") | has(s, "meter", "metre"), "km")
        )

    return F.when(F.coalesce(raw, F.lit("")) != "", _spelled(raw, named))


def unit_origin(raw: Column) -> Column:
    """explicit, ambiguous (a bare m) or default: how the user's unit came about."""
    s = F.lower(F.regexp_replace(raw, STRIP, ""))
    return F.when(normalize_user_unit(raw).isNull(), "default").when(s.isin("m", "m."), "ambiguous").otherwise("explicit")


def unit_preference(user: Column, dotted: bool = True) -> Column:
    """Unit that a prompt asks for, null if none; `dotted` also takes n.m. for nautical miles."""
    nautical = ("sea mile", "nmi", "nm", "nautical") + (("n.m.",) if dotted else ())
    return let(F.lower(user), lambda u: F.when(contains_any(u, nautical), "nmi").when(contains_any(u, ("klick", "click")), "km").when(contains_any(u, (" mile", "(mi", "statute")), "mi").when(contains_any(u, (" km", "kilometer", "kilometre")), "km"))
