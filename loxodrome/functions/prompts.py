"""User prompts, intent recaps, narration and the assistant's texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import coords, geodesy, noise, phrases, units
from .geodesy import let
from .sampling import Draws

MODES = ("normal", "short_q", "coords_only", "fragment", "arrow", "shout")
# Unit weights by mode, how often a short question names a unit, and what stands between bare coordinates.
TRAIN_WEIGHTS = {"normal": (0.40, 0.45, 0.15), "short_q": (0.40, 0.50, 0.10), "fragment": (0.35, 0.50, 0.15), "arrow": (0.35, 0.50, 0.15), "shout": (0.30, 0.60, 0.10)}
EVAL_WEIGHTS = {"normal": (0.20, 0.60, 0.20), "short_q": (0.25, 0.50, 0.25), "fragment": (0.25, 0.50, 0.25), "arrow": (0.25, 0.50, 0.25), "shout": (0.25, 0.50, 0.25)}
P_SHORT_UNIT = 0.55
SEPARATORS = (" ", "  ", "\n", "  →  ")


def pick_variant(unit: Column, d: Draws, slot: str) -> Column:
    """One of the spellings of a unit."""
    out = F.lit(None).cast("string")
    for u, spellings in phrases.UNIT_VARIANTS.items():
        out = F.when(unit == u, d.choose(spellings, f"{slot}:{u}")).otherwise(out)
    return out


def user_prompt(a: Column, b: Column, d: Draws, weights: dict, bank: dict, slot: str = "user") -> Column:
    """Struct text, raw_unit, mode of a prompt without typos; raw_unit is null where the mode names none."""
    def asked(mode: Column) -> Column:
        unit = F.lit(None).cast("string")
        for m, w in weights.items():
            unit = F.when(mode == m, d.weighted(dict(zip(("km", "mi", "nmi"), w, strict=True)), f"{slot}:unit:{m}")).otherwise(unit)
        unit = F.when((mode == "short_q") & ~d.maybe(P_SHORT_UNIT, f"{slot}:named"), None).otherwise(unit)
        return F.struct(mode.alias("mode"), let(unit, lambda u: pick_variant(u, d, f"{slot}:spelling")).alias("raw"))

    # The wording of the modes without templates.
    def write(s: Column) -> Column:
        raw = s.raw
        text = (
            F.when(s["mode"] == "normal", phrases.fill_any(bank["user_patterns"], {"A": a, "B": b, "unit": raw}, d, f"{slot}:template"))
            .when((s["mode"] == "short_q") & raw.isNotNull(), F.concat(F.lit("how far from "), a, F.lit(" to "), b, F.lit(" in "), raw, F.lit("?")))
            .when(s["mode"] == "short_q", F.concat(F.lit("how far from "), a, F.lit(" to "), b, F.lit("?")))
            .when(s["mode"] == "coords_only", F.concat(a, d.choose(SEPARATORS, f"{slot}:sep"), b))
            .when(s["mode"] == "fragment", F.concat(F.lit("distance in "), raw, F.lit(": "), a, F.lit(" to "), b))
            .when(s["mode"] == "arrow", F.concat(a, F.lit(" -> "), b, F.lit(" in "), raw, F.lit("?")))
            .otherwise(F.concat(F.lit("DISTANCE??? "), a, F.lit(" "), b, F.lit(" ("), raw, F.lit(")")))
        )
        return F.struct(text.alias("text"), raw.alias("raw_unit"), s["mode"].alias("mode"))

    return let(let(d.choose(MODES, f"{slot}:mode"), asked), write)


def long_label(unit: Column, d: Draws, slot: str) -> Column:
    out = unit
    for u, names in phrases.LONG_NAMES.items():
        out = F.when(unit == u, d.choose(names, f"{slot}:{u}")).otherwise(out)
    return out


def fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


def intent_recap(unit: Column, origin: Column, raw: Column, a: tuple[Column, Column], b: tuple[Column, Column], d: Draws, bank: dict, slot: str = "intent") -> Column:
    """What was asked for, and a line with the coordinates."""
    where = {"alat": fixed(a[0], 6), "alon": fixed(a[1], 6), "blat": fixed(b[0], 6), "blon": fixed(b[1], 6)}

    def write(x: Column) -> Column:
        slots = {"op": d.choose(bank["intent_openers"], f"{slot}:op"), "unit_long": long_label(x.unit, d, f"{slot}:long"), "raw_unit": F.trim(F.coalesce(x.raw, F.lit("")))}
        line = lambda kind: phrases.fill_any(bank[f"intent_{kind}"], slots, d, f"{slot}:line")
        return F.when(x.origin == "explicit", line("explicit")).when(x.origin == "ambiguous", line("ambiguous")).otherwise(line("default"))

    line = let(F.struct(unit.alias("unit"), origin.alias("origin"), raw.alias("raw")), write)
    return F.concat(line, F.lit("\n- "), phrases.fill_any(bank["intent_coords"], where, d, f"{slot}:coords"))



def narrate_distance(method: Column, km: Column, unit: Column, angle: Column, iterations: Column, brief: bool) -> Column:
    """The numbers behind a distance, briefly or with constants."""
    places = 1 if brief else 3
    converted = let(units.convert_km(km, unit), lambda c: F.concat(fixed(c["value"], places), F.lit(" "), c["unit"]))
    result = F.concat(fixed(km, places), F.lit(" km = "), converted, F.lit("."))
    sphere = F.concat(F.lit(f"Sphere of {geodesy.EARTH_RADIUS_KM} km; angle "), fixed(angle, 4 if brief else 6), F.lit(" rad; distance "), result)
    ellipsoid = F.concat(F.lit("Ellipsoid WGS-84"), F.lit("") if brief else F.concat(F.lit(f" (a = {geodesy.WGS84_A} m, b = {geodesy.WGS84_B:.1f} m), settled in "), iterations.cast("string"), F.lit(" rounds")), F.lit("; distance "), result)
    return F.when(method == "vincenty", ellipsoid).otherwise(sphere)


def why_lines(gut: Column, ballpark: Column, d: Draws, bank: dict, slot: str = "why") -> Column:
    """Array of one or two reasons for a short span, two for a long one."""
    arc = geodesy.long_arc(gut.angle)
    small = F.array(*[phrases.fill(t, {"mid_lat": fixed(gut.mid_lat, 0), "ball_km": ballpark.cast("string")}) for t in bank["why_small"]])
    large = F.array(*[phrases.fill(t, {"frac_pct": fixed(arc.frac_pct, 1), "per10deg_km": fixed(arc.per10deg_km, 0), "half_circum_km": fixed(arc.half_circum_km, 0)}) for t in bank["why_large"]])
    many = F.when(d.uniform(f"{slot}:many") < 0.5, 1).otherwise(2)
    return F.when(gut.small, d.sample(small, many, slot)).otherwise(d.sample(large, 2, slot))


def analysis_text(row: dict[str, Column], d: Draws, bank: dict) -> Column:
    """The assistant's reasoning; `row` has unit, origin, raw, shown coordinates, gut, ballpark, method, km, angle, iterations, dropped_a, dropped_b, fell_back."""
    gut, unit = row["gut"], row["unit"]
    names = F.when(row["method"] == "vincenty", d.choose(bank["vincenty_names"], "method:v")).otherwise(d.choose(bank["haversine_names"], "method:h"))
    planned = F.when(row["fell_back"] | (row["method"] == "vincenty"), d.choose(bank["vincenty_overview"], "overview:v")).otherwise(d.choose(bank["haversine_overview"], "overview:h"))
    small = F.concat(F.lit("- lon "), fixed(gut.dlon, 1), F.lit("°, lat "), fixed(gut.dlat, 1), F.lit("°; EW "), F.rint(gut.ew_km).cast("bigint").cast("string"), F.lit(" km, NS "), F.rint(gut.ns_km).cast("bigint").cast("string"), F.lit(" km"))
    large = F.concat(F.lit("- lon "), fixed(gut.dlon, 1), F.lit("°; central angle "), fixed(gut.angle, 2), F.lit(" rad"))
    missing = F.array_join(F.filter(F.array(F.when(row["dropped_a"], "A"), F.when(row["dropped_b"], "B")), lambda x: x.isNotNull()), " and ")
    ball = let(units.convert_km(row["ballpark"].cast("double"), unit), lambda b: F.concat(F.rint(b["value"]).cast("bigint").cast("string"), F.lit(" "), b["unit"]))
    lines = F.array(
        d.choose(bank["analysis_openers"], "analysis:open"),
        intent_recap(unit, row["origin"], row["raw"], row["a"], row["b"], d, bank),
        F.when(missing != "", F.concat(F.lit("- no hemisphere letter for "), missing, F.lit(", so the sign decides."))),
        d.choose(bank["gut_openers"], "gut:open"),
        F.when(gut.small, small).otherwise(large),
        F.concat(F.lit("- about "), row["ballpark"].cast("string"), F.lit(" km, or "), ball),
        F.array_join(why_lines(gut, row["ballpark"], d, bank), "\n"),
        F.concat(d.choose(bank["method_transitions"], "method:to"), F.lit(" "), names),
        F.concat(F.lit("- "), planned),
        phrases.fill_any(bank["calc_intro"], {"method_label": names}, d, "calc"),
        F.when(row["fell_back"], F.concat(F.lit("- "), d.choose(bank["fallback"], "fallback"))),
        narrate_distance(row["method"], row["km"], unit, row["angle"], row["iterations"], True),
    )
    return noise.format_variation(F.array_join(F.array_compact(lines), "\n"), d, phrases.FORMAT_NOISE["analysis"], "form:analysis")


def final_text(row: dict[str, Column], d: Draws, bank: dict) -> Column:
    """The assistant's answer, by the format of the coordinates."""
    unit, fmt = row["unit"], row["fmt"]
    rule = F.when(fmt == "DMS", "deg + min/60 + sec/3600, minus for S and W").when(fmt == "DMM", "deg + min/60, minus for S and W")
    names = F.when(row["method"] == "vincenty", d.choose(bank["vincenty_names"], "final:v")).otherwise(d.choose(bank["haversine_names"], "final:h"))

    def how(c: Column) -> Column:
        return F.when(c["unit"] == "mi", "km / 1.609344").when(c["unit"] == "nmi", "km / 1.852").otherwise("already km")

    def compared(gap: Column) -> Column:
        return F.when(gap.isNotNull(), phrases.fill_any(bank["compare"], {"approx_km": fixed(row["approx"], 0), "exact_km": fixed(row["km"], 1), "diff_km": fixed(gap.diff_km, 1), "diff_pct": fixed(gap.diff_pct, 1)}, d, "compare"))

    def lines(c: Column) -> Column:
        return _final_lines(row, d, bank, c, rule, names, how(c), let(geodesy.intuition_gap(row["km"], row["approx"]), compared))

    text = let(units.convert_km(row["km"], unit), lambda c: F.array_join(F.array_compact(lines(c)), "\n"))
    return noise.format_variation(text, d, phrases.FORMAT_NOISE["final"], "form:final")


def _final_lines(row: dict[str, Column], d: Draws, bank: dict, c: Column, rule: Column, names: Column, how: Column, compared: Column) -> Column:
    unit, fmt = row["unit"], row["fmt"]
    (alat, alon), (blat, blon) = row["a"], row["b"]
    return F.array(
        d.choose(bank["final_intro"], "final:intro"),
        F.lit(""),
        d.choose(bank["step1"], "final:step1"),
        F.concat(F.lit("A = "), coords.format_coord(*row["exact_a"], fmt), F.lit("; B = "), coords.format_coord(*row["exact_b"], fmt)),
        F.when(fmt != "DD", F.concat(F.lit("\n"), d.choose(bank["convert"], "final:convert"), F.lit(": "), rule)),
        F.when(fmt != "DD", F.concat(F.lit("A = "), fixed(alat, 6), F.lit("°, "), fixed(alon, 6), F.lit("°; B = "), fixed(blat, 6), F.lit("°, "), fixed(blon, 6), F.lit("°"))),
        F.lit(""),
        phrases.fill_any(bank["method_used"], {"method_label": names}, d, "final:method"),
        narrate_distance(row["method"], row["km"], unit, row["angle"], row["iterations"], False),
        F.lit(""),
        d.choose(bank["unit_heading"], "final:unit"),
        F.concat(F.lit("To "), long_label(c["unit"], d, "final:long"), F.lit(": "), how, F.lit(" = "), fixed(c["value"], 3), F.lit(" "), c["unit"]),
        compared,
        F.lit(""),
        d.choose(bank["answer"], "final:answer"),
        F.concat(fixed(c["value"], 3), F.lit(" "), c["unit"]),
    )
