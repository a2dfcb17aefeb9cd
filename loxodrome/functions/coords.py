"""Sexagesimal coordinates: components, rendering and reading back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import let


def to_dms(v: Column) -> Column:
    """Struct deg, min, sec, sign; seconds to two places, carried over at 60."""

    def parts(a: Column) -> Column:
        rest = (a - F.floor(a)) * 60
        return let(F.struct(F.floor(a).alias("d"), F.floor(rest).alias("m"), F.round((rest - F.floor(rest)) * 60, 2).alias("s")), carry)

    def carry(p: Column) -> Column:
        m = p.m + F.when(p.s >= 60, 1).otherwise(0)
        return F.struct((p.d + F.when(m >= 60, 1).otherwise(0)).cast("int").alias("deg"), F.when(m >= 60, 0).otherwise(m).cast("int").alias("min"), F.when(p.s >= 60, 0.0).otherwise(p.s).alias("sec"), F.when(v >= 0, 1).otherwise(-1).alias("sign"))

    return let(F.abs(v), parts)


def to_dmm(v: Column) -> Column:
    """Struct deg, min, sign; minutes to three places, carried over at 60."""

    def parts(a: Column) -> Column:
        return let(F.struct(F.floor(a).alias("d"), F.round((a - F.floor(a)) * 60, 3).alias("m")), lambda p: F.struct((p.d + F.when(p.m >= 60, 1).otherwise(0)).cast("int").alias("deg"), F.when(p.m >= 60, 0.0).otherwise(p.m).alias("min"), F.when(v >= 0, 1).otherwise(-1).alias("sign")))

    return let(F.abs(v), parts)


def dms_to_dd(c: Column) -> Column:
    return (c["deg"] + c["min"] / 60 + c["sec"] / 3600) * c["sign"]


def dmm_to_dd(c: Column) -> Column:
    return (c["deg"] + c["min"] / 60) * c["sign"]


def shown(v: Column, fmt: Column) -> Column:
    """Decimal degrees that a reader of the rendered coordinate gets."""
    return F.when(fmt == "DMS", dms_to_dd(to_dms(v))).when(fmt == "DMM", dmm_to_dd(to_dmm(v))).otherwise(v)


def _hemisphere(c: Column, plus: str, minus: str) -> Column:
    return F.when(c["sign"] >= 0, plus).otherwise(minus)


def format_dd(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f, %.6f", lat, lon)


def format_dms(lat: Column, lon: Column) -> Column:
    one = lambda v, p, m: let(to_dms(v), lambda c: F.format_string("%d° %d′ %.2f″ %s", c["deg"], c["min"], c["sec"], _hemisphere(c, p, m)))
    return F.concat_ws(", ", one(lat, "N", "S"), one(lon, "E", "W"))


def format_dmm(lat: Column, lon: Column) -> Column:
    one = lambda v, p, m: let(to_dmm(v), lambda c: F.format_string("%d° %.3f′ %s", c["deg"], c["min"], _hemisphere(c, p, m)))
    return F.concat_ws(", ", one(lat, "N", "S"), one(lon, "E", "W"))


def format_coord(lat: Column, lon: Column, fmt: Column) -> Column:
    return let(F.struct(lat.alias("lat"), lon.alias("lon")), lambda c: F.when(fmt == "DMS", format_dms(c.lat, c.lon)).when(fmt == "DMM", format_dmm(c.lat, c.lon)).otherwise(format_dd(c.lat, c.lon)))
