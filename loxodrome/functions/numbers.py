"""Numbers in free text: spans, readings, units, context features and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import KM_PER_MILE, KM_PER_NAUTICAL_MILE, let
from .units import contains_any, normalize_unit

# The pattern of a number with an optional unit, and the words that count for or against a number.
NUMBER = (
    r"(?iuU)([+-]?\d[\d\s  ,\.'’]*\d|\d(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    r"(?:\s*(klicks?|clicks?|km(?:s)?|kilometer(?:s)?|kilometre(?:s)?|mi\.?|mile(?:s)?|statute(?:\s+miles?)?|sm|"
    r"nmi|nm|n\.m\.|nautical(?:\s+miles?)?|sea(?:\s+miles?)?))?"
)
DISTANCE_WORDS = ("distance", "final", "answer", "result", "≈", "~", "about", "roughly", "km", "mi", "nmi", "nautical", "sea mile", "statute", "klick", "click")
FINAL_WORDS = ("≈", "~", "about", "roughly", "final", "answer", "result")
DEGREE_MARKS = ("°", " deg", "deg ", "degrees", "′", "'", "″", '"', "min", "sec")
MATH_WORDS = ("π", "pi", "rad", "radian")
RADIUS_WORDS = ("r=6371", "r = 6371", "earth radius", "mean radius", "6371.0088", "6371 km", "r≈6371")
#: Name, words, characters on either side of the number's start, points.
FEATURES = (
    ("near_keyword", DISTANCE_WORDS, 80, 3),
    ("finalish", FINAL_WORDS, 40, 2),
    ("dms_penalty", DEGREE_MARKS, 20, -6),
    ("math_penalty", MATH_WORDS, 30, -4),
    ("radius_penalty", RADIUS_WORDS, 40, -6),
)
UNIT_BONUS, TAIL_BONUS, TINY_PENALTY, TINY_KM = 5, 2, -1, 5.0
TAIL_CHARS, CONTEXT_CHARS = 1200, 40
BREAKDOWN = ("unit_bonus", "near_keyword", "finalish", "tail_bias", "dms_penalty", "math_penalty", "radius_penalty", "tiny_penalty", "ambig_sep", "close_to_gt")


def number_spans(text: Column) -> Column:
    """Array of structs num, unit (null without), start, end of all matches from left to right; positions count code points from 0.

    A match starts at the first digit that is left, or at the sign before it, so its text can't occur between the match before
    and its place: locating it after that match's end finds its span. Texts are searched once: a number ends with its match's last
    digit, as no unit has one, and the unit is what stands beyond, without the space before it.
    """

    def fold(s: Column, m: Column) -> Column:
        last = F.get(s, F.size(s) - 1)
        start = F.call_function("locate", m, text, F.coalesce(last.start + F.length(last.m), F.lit(0)) + 1) - 1
        return F.concat(s, F.array(F.struct(m.alias("m"), start.alias("start"))))

    def parts(x: Column) -> Column:
        def of(num: Column) -> Column:
            unit = F.when(F.length(num) < F.length(x.m), F.regexp_replace(F.substring(x.m, F.length(num) + 1, F.length(x.m)), r"(?U)^\s+", ""))
            return F.struct(num.alias("num"), unit.alias("unit"), x.start.alias("start"), (x.start + F.length(x.m)).alias("end"))

        return let(F.regexp_replace(x.m, r"(?U)\D+$", ""), of)

    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(F.aggregate(found, F.array().cast("array<struct<m:string,start:int>>"), fold), parts)


def _plain(num: Column) -> Column:
    """Without grouping apostrophes and with plain spaces, trimmed."""
    s = F.translate(num, "\u00a0\u202f", "  ")
    return F.translate(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), "’'", "")


def _absolute(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.abs(text.try_cast("double")))


def parse_number(num: Column) -> Column:
    """Array of a number's readings: one, two where a single separator before three digits may be either, none if it can't be read."""

    def read(s: Column) -> Column:
        core = F.replace(s, F.lit(" "), F.lit(""))
        dot, comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
        last_dot = F.length(core) - F.instr(F.reverse(core), ".")
        last_comma = F.length(core) - F.instr(F.reverse(core), ",")
        no_comma, no_dot = F.replace(core, F.lit(","), F.lit("")), F.replace(core, F.lit("."), F.lit(""))
        as_point = F.replace(core, F.lit(","), F.lit("."))
        both = F.when(last_dot > last_comma, no_comma).otherwise(F.replace(no_dot, F.lit(","), F.lit(".")))
        two = core.rlike(r"^\d+[,.]\d{3}$")
        values = (
            F.when(dot & comma, F.array(_absolute(both)))
            .when(comma & two, F.array(_absolute(as_point), _absolute(no_comma)))
            .when(comma, F.array(_absolute(as_point)))
            .when(dot & two, F.array(_absolute(core), _absolute(no_dot)))
            .otherwise(F.array(_absolute(core)))
        )
        return F.array_distinct(F.array_compact(values))

    # most numbers are bare digits, perhaps with a point that can't group thousands
    return F.when(num.rlike(r"^[0-9]+(\.([0-9]{1,2}|[0-9]{4,}))?\z"), F.array(num.try_cast("double"))).otherwise(let(_plain(num), read))


def parse_float_locale(num: Column) -> Column:
    """A number's single reading: the rightmost separator is the decimal mark unless the only one groups thousands."""

    def read(s: Column) -> Column:
        core = F.replace(s, F.lit(" "), F.lit(""))
        dot, comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
        last_dot, last_comma = F.length(core) - F.instr(F.reverse(core), "."), F.length(core) - F.instr(F.reverse(core), ",")
        no_comma, no_dot = F.replace(core, F.lit(","), F.lit("")), F.replace(core, F.lit("."), F.lit(""))
        as_point = F.replace(core, F.lit(","), F.lit("."))
        clean = (
            F.when(dot & comma & (last_dot > last_comma), no_comma)
            .when(dot & comma, F.replace(no_dot, F.lit(","), F.lit(".")))
            .when(comma & core.rlike(r"^[+-]?\d{1,3}(,\d{3})+$"), no_comma)
            .when(comma, as_point)
            .when(dot & core.rlike(r"^[+-]?\d{1,3}(\.\d{3})+$"), no_dot)
            .otherwise(core)
        )
        return _absolute(F.regexp_replace(clean, r"[^0-9eE.+\-]", ""))

    return let(_plain(num), read)


def near_any(text: Column, start: Column, window: int, needles) -> Column:
    """Whether one of the lower-case needles stands within `window` characters on either side of `start`."""
    low = F.greatest(start - window, F.lit(0))
    least = [n for n in needles if not any(m != n and m in n for m in needles)]
    return let(F.lower(F.substring(text, low + 1, start + window - low)), lambda near: contains_any(near, least))


def interpretations(value: Column) -> Column:
    """km of a bare number read as km, miles and nautical miles."""
    return F.struct(value.alias("km"), (value * KM_PER_MILE).alias("mi"), (value * KM_PER_NAUTICAL_MILE).alias("nmi"))


def _points(hit: Column, points: int) -> Column:
    return F.when(hit, F.lit(points))


def extract_candidates(text: Column, tail_chars: int = TAIL_CHARS) -> Column:
    """Array of candidates: raw_value, unit_raw, unit_norm, start, end, context, score, score_detail, km_interps."""

    features = ("tail_bias", *[x[0] for x in FEATURES])

    def one(m: Column) -> Column:
        shared = F.struct(
            normalize_unit(m.unit).alias("unit_norm"),
            *[_points(near_any(text, m.start, window, words), points).alias(name) for name, words, window, points in FEATURES],
            _points(m.start > F.length(text) - tail_chars, TAIL_BONUS).alias("tail_bias"),
            parse_number(m.num).alias("values"),
        )

        def of(s: Column) -> Column:
            named = _points(s.unit_norm.isNotNull(), UNIT_BONUS)
            ambiguous = _points(F.size(s["values"]) > 1, 0)
            low = F.greatest(m.start - CONTEXT_CHARS, F.lit(0))
            score = F.coalesce(named, F.lit(0))
            for n in features:
                score = score + F.coalesce(s[n], F.lit(0))

            def reading(v: Column) -> Column:
                tiny = _points(v < TINY_KM, TINY_PENALTY)
                own = {"unit_bonus": named, "tiny_penalty": tiny, "ambig_sep": ambiguous, "close_to_gt": F.lit(None).cast("int")}
                detail = F.struct(*[(own[n] if n in own else s[n]).alias(n) for n in BREAKDOWN])
                return F.struct(v.alias("raw_value"), m.unit.alias("unit_raw"), s.unit_norm.alias("unit_norm"), m.start.alias("start"), m.end.alias("end"), F.substring(text, low + 1, m.end + CONTEXT_CHARS - low).alias("context"), (score + F.coalesce(tiny, F.lit(0))).alias("score"), detail.alias("score_detail"), interpretations(v).alias("km_interps"))

            return F.transform(s["values"], reading)

        return let(shared, of)

    # each once: a number's readings are distinct, and no two matches share a start
    return F.flatten(F.transform(number_spans(text), one))


def dedup_candidates(candidates: Column) -> Column:
    """Each candidate once, of lists that may share some."""
    return F.array_distinct(candidates)


def gt_boost(candidate: Column, expected_km: Column) -> Column:
    """Points for a candidate of which some reading is within 1, 5 or 10 per cent of the reference (evaluation only)."""
    best = F.least(*[F.abs(candidate.km_interps[u] - expected_km) for u in ("km", "mi", "nmi")]) / expected_km
    return F.when(expected_km > 0, F.when(best < 0.01, 6).when(best < 0.05, 3).when(best < 0.10, 1))


def boosted(candidates: Column, expected_km: Column) -> Column:
    def one(c: Column) -> Column:
        return let(gt_boost(c, expected_km), lambda b: c.withField("score", c.score + F.coalesce(b, F.lit(0))).withField("score_detail", c.score_detail.withField("close_to_gt", b)))

    return F.transform(candidates, one)


def rank_candidates(candidates: Column) -> Column:
    """By score, then place, then value, all descending."""
    dealt = F.transform(candidates, lambda c, i: F.struct(c.score.alias("score"), c.start.alias("start"), c.raw_value.alias("value"), (-i).alias("i"), c.alias("c")))
    return F.transform(F.sort_array(dealt, asc=False), lambda s: s.c)  # i differs, so candidates themselves are never compared


def pack_median(ranked: Column, most: int = 5) -> Column:
    """Upper median of all readings of the first candidates."""
    values = F.array_sort(F.flatten(F.transform(F.slice(ranked, 1, most), lambda c: F.array(c.km_interps.km, c.km_interps.mi, c.km_interps.nmi))))
    return let(values, lambda v: F.get(v, (F.size(v) / 2).cast("int")))


def resolve_unit(top: Column, preference: Column, median: Column) -> Column:
    """Struct unit, km: the candidate's own unit, the user's, or that of the reading closest to the median (ties: km, mi, nmi)."""
    unit = F.coalesce(top.unit_norm, preference)
    closest = let(median, lambda m: F.array_min(F.array(*[F.struct(F.abs(top.km_interps[u] - m).alias("diff"), F.lit(i).alias("i"), F.lit(u).alias("unit"), top.km_interps[u].alias("km")) for i, u in enumerate(("km", "mi", "nmi"))])))
    own = F.when(unit == "km", top.km_interps.km).when(unit == "mi", top.km_interps.mi).when(unit == "nmi", top.km_interps.nmi)
    return F.when(unit.isNotNull(), F.struct(unit.alias("unit"), own.alias("km"))).otherwise(let(closest, lambda c: F.struct(c.unit.alias("unit"), c.km.alias("km"))))


def bucket_points(expected_km: Column, km: Column) -> Column:
    """Struct bucket, points, rel_error."""
    rel = F.abs(km - expected_km) / expected_km

    def of(r: Column) -> Column:
        bucket = F.when(r < 0.01, "perfect").when(r < 0.05, "approx").when(r < 0.10, "pretty_close").otherwise("wrong")
        points = F.when(r < 0.01, 10).when(r < 0.05, 3).when(r < 0.10, 1).otherwise(0)
        return F.struct(bucket.alias("bucket"), points.alias("points"), r.alias("rel_error"))

    return let(F.when((expected_km > 0) & km.isNotNull(), rel).otherwise(F.lit(float("inf"))), of)
