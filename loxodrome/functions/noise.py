"""Noise that people put into coordinates and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coords import format_coord
from .geodesy import let
from .sampling import Draws

# Probabilities of noise in coordinates and of typos, and the marks that replace others.
NOISE = {
    "p_coord_drop_deg": 0.25,
    "p_coord_replace_prime": 0.35,
    "p_coord_replace_dblprime": 0.35,
    "p_coord_remove_comma": 0.20,
    "p_coord_extra_spaces": 0.40,
    "p_coord_drop_hemi": 0.05,
    "p_user_typos": 0.08,
    "p_system_typos": 0.05,
}
PRIMES, DOUBLE_PRIMES, DEGREES = ("'", "", "’"), ('"', "", "”"), ("", " º", " deg")
COMMAS, NO_COMMAS = (",", ", ", " ,", "  ,  ", " "), ("", " ", "  ")
AFTER_DEGREE, BEFORE_PRIME, BEFORE_DOUBLE = ("° ", " °", "  ° ", "°"), (" ′", "′", "  ′"), (" ″", "″", "  ″")
CAPS = {"p_all_caps_system": 0.08, "p_all_caps_user": 0.10, "full": 0.35, "partial": 0.65}


def _replaced(text: Column, old: str, new: Column, gate: Column) -> Column:
    """All of `old` by `new` where `gate` holds; the text is mentioned once, so that steps can be chained."""
    return F.replace(text, F.lit(old), F.when(gate, new).otherwise(old))


def noise_marks(text: Column, d: Draws, cfg=NOISE, slot: str = "") -> Column:
    """Prime, double prime and degree marks: as they are, in ASCII, curly, spelled out or gone."""
    for mark, key, options in (("′", "p_coord_replace_prime", PRIMES), ("″", "p_coord_replace_dblprime", DOUBLE_PRIMES), ("°", "p_coord_drop_deg", DEGREES)):
        text = _replaced(text, mark, d.choose(options, f"{slot}{key}:to"), d.maybe(cfg[key], f"{slot}{key}"))
    return text


def noise_spacing(text: Column, d: Draws, cfg=NOISE, slot: str = "") -> Column:
    """Spaces and commas: restyled by four independent picks, commas perhaps removed."""

    def restyled(t: Column) -> Column:
        spaced = F.regexp_replace(t, r"(?U)\s+", " ")
        spaced = F.regexp_replace(spaced, F.lit(r"(?U)\s*,\s*"), d.choose(COMMAS, f"{slot}comma"))
        for old, options in (("° ", AFTER_DEGREE), (" ′", BEFORE_PRIME), (" ″", BEFORE_DOUBLE)):
            spaced = F.replace(spaced, F.lit(old), d.choose(options, f"{slot}space:{old.strip()}"))
        return F.when(d.maybe(cfg["p_coord_extra_spaces"], f"{slot}p_coord_extra_spaces"), spaced).otherwise(t)

    return _replaced(let(text, restyled), ",", d.choose(NO_COMMAS, f"{slot}nocomma"), d.maybe(cfg["p_coord_remove_comma"], f"{slot}p_coord_remove_comma"))


def noise_hemi(text: Column, d: Draws, cfg=NOISE, slot: str = "", each: bool = True) -> Column:
    """Struct text, dropped. each: every letter N, S, E, W has its own coin; else one coin for the first of them that is there."""
    without = lambda t, h: F.regexp_replace(t, f"^([^{h}]*){h}", "$1")
    if not each:
        hit = d.maybe(cfg["p_coord_drop_hemi"], f"{slot}hemi")

        def one(t: Column) -> Column:
            gone = F.coalesce(*[F.when(F.contains(t, F.lit(h)), without(t, h)) for h in "NSEW"], t)
            return F.struct(F.when(hit, gone).otherwise(t).alias("text"), (hit & t.rlike("[NSEW]")).alias("dropped"))

        return let(text, one)
    state = F.struct(text.alias("text"), F.lit(False).alias("dropped"))
    for h in "NSEW":
        state = let(state, _without_letter(h, d.maybe(cfg["p_coord_drop_hemi"], f"{slot}hemi:{h}"), without))
    return state


def _without_letter(h: str, coin: Column, without):
    return lambda s: F.struct(F.when(coin, without(s.text, h)).otherwise(s.text).alias("text"), (s.dropped | (coin & F.contains(s.text, F.lit(h)))).alias("dropped"))


def noisy_coord(lat: Column, lon: Column, fmt: Column, d: Draws, slot: str, cfg=NOISE, each: bool = True) -> Column:
    """Struct text, dropped: a rendered coordinate with noise; decimal degrees only get spacing noise."""
    spaced = noise_spacing(noise_marks(format_coord(lat, lon, fmt), d, cfg, slot), d, cfg, slot)  # decimal degrees have no marks
    return let(spaced, lambda s: F.when(fmt == "DD", F.struct(s.alias("text"), F.lit(False).alias("dropped"))).otherwise(noise_hemi(s, d, cfg, slot, each)))


def inject_typos(text: Column, d: Draws, p: float, slot: str = "typo") -> Column:
    """Drop a few letters, from the left, one in four, at most a hundredth of the length (one at least); never digits, signs or N, S, E, W."""

    def typed(t: Column) -> Column:
        budget = F.greatest(F.lit(1), F.floor(F.length(t) * 0.01)).cast("int")

        def fold(s: Column, c: Column) -> Column:
            may = c.rlike(r"\p{L}") & ~c.isin("N", "S", "E", "W") & (s.dropped < budget)
            coin = may & (d.uniform(F.concat_ws(":", F.lit(slot), s.at.cast("string"))) < 0.25)
            return let(coin, lambda drop: F.struct(F.concat(s.out, F.when(drop, "").otherwise(c)).alias("out"), (s.dropped + drop.cast("int")).alias("dropped"), (s.at + 1).alias("at")))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("dropped"), F.lit(0).alias("at"))
        return F.when(d.maybe(p, f"{slot}:gate"), F.aggregate(F.split(t, ""), start, fold, lambda s: s.out)).otherwise(t)

    return let(text, typed)


def apply_caps(text: Column, d: Draws, p: float, slot: str = "caps") -> Column:
    """All in capitals, or a sixth of the purely alphabetic words (one at least)."""
    return let(text, lambda t: _capped(t, d, p, slot))


def _capped(text: Column, d: Draws, p: float, slot: str) -> Column:
    tokens = F.split(text, r"(?U)(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(r"^\p{L}+$"), i)), lambda i: i.isNotNull())
    chosen = d.sample(at, F.greatest(F.lit(1), F.floor(F.size(at) / 6)).cast("int"), f"{slot}:which")
    partial = let(chosen, lambda own: F.array_join(F.transform(tokens, lambda t, i: F.when(F.array_contains(own, i), F.upper(t)).otherwise(t)), ""))
    full = d.weighted({"full": CAPS["full"], "partial": CAPS["partial"]}, f"{slot}:mode") == "full"
    return F.when(~d.maybe(p, f"{slot}:gate"), text).when(full, F.upper(text)).otherwise(partial)


def format_variation(text: Column, d: Draws, cfg: dict, slot: str = "form") -> Column:
    """Bullet runs on one line, then all or some line breaks collapsed."""
    return let(text, lambda t: _formed(t, d, cfg, slot))


def _formed(text: Column, d: Draws, cfg: dict, slot: str) -> Column:
    bullet = r"^\s*[-*•—]\s+"
    bulleted = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.lit("").alias("out"), F.lit(False).alias("run"), F.lit(True).alias("first")),
        lambda s, line: let(line.rlike(bullet), lambda hit: F.struct(F.concat(s.out, F.when(s.first, "").when(s.run & hit, " • ").otherwise("\n"), F.when(hit, F.trim(F.regexp_replace(line, bullet, ""))).otherwise(line)).alias("out"), hit.alias("run"), F.lit(False).alias("first"))),
        lambda s: s.out,
    )
    compact = F.when(d.maybe(cfg["p_compact_bullets"], f"{slot}:bullets"), bulleted).otherwise(text)
    all_of, some_of, (low, high) = cfg["p_collapse_all"], cfg["p_collapse_some"], cfg["collapse_some_fraction_range"]

    def some(t: Column) -> Column:
        def joined(x: Column) -> Column:
            brk = lambda i: F.when(i == F.size(x.lines) - 1, "").when(d.uniform(F.concat_ws(":", F.lit(f"{slot}:line"), i.cast("string"))) < x.share, " ").otherwise("\n")
            return F.array_join(F.transform(x.lines, lambda line, i: F.concat(line, brk(i))), "")

        return F.trim(F.regexp_replace(let(F.struct(F.split(t, "\n").alias("lines"), d.between(f"{slot}:share", low, high).alias("share")), joined), " {2,}", " "))

    def vary(t: Column) -> Column:
        return let(d.uniform(f"{slot}:roll"), lambda roll: F.when(roll < all_of, F.trim(F.regexp_replace(t, r"\s*\n\s*", " "))).when(roll < all_of + some_of, some(t)).otherwise(t))

    return let(compact, vary)
