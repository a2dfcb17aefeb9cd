"""The engine's own queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import channels, coords, geodesy, messages, noise, numbers, phrases, prompts, units
from ..functions.sampling import Draws
from ..operators import generate, score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Coordinates come from keys by modular arithmetic that both engines evaluate alike.
_P = """p AS (SELECT o_orderkey AS k, (o_orderkey * 7919) % 179001 / 1000.0::DOUBLE - 89.5 AS alat, (o_orderkey * 104729) % 359001 / 1000.0::DOUBLE - 179.5 AS alon,
 (o_orderkey * 15485863) % 179001 / 1000.0::DOUBLE - 89.5 AS blat, (o_orderkey * 32452843) % 359001 / 1000.0::DOUBLE - 179.5 AS blon FROM orders)"""
_HAV_A = "pow(sin((radians(blat) - radians(alat)) / 2), 2) + cos(radians(alat)) * cos(radians(blat)) * pow(sin((radians(blon) - radians(alon)) / 2), 2)"
_H = f"{_P}, h0 AS (SELECT *, {_HAV_A} AS ha FROM p), h AS (SELECT *, 2 * atan2(sqrt(ha), sqrt(greatest(1 - ha, 0))) AS hc, 6371.0088 * 2 * atan2(sqrt(ha), sqrt(greatest(1 - ha, 0))) AS km FROM h0)"
_U = "('0x' || substr(md5('{seed}:' || k || ':{slot}'), 1, 13))::BIGINT / 4503599627370496::DOUBLE"


def u(slot: str, seed: int = 0) -> str:
    return _U.format(seed=seed, slot=slot)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """A file of few row groups is read by as few tasks: its rows dealt to all of them by a key, by which joins find them dealt already."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k")), "k")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda m, n, r: F.expr(f"(k * {m}L) % {n}L / 1000.0D - {r}D")
    return orders(spark, sf).select("k", at(7919, 179001, 89.5).alias("alat"), at(104729, 359001, 179.5).alias("alon"), at(15485863, 179001, 89.5).alias("blat"), at(32452843, 359001, 179.5).alias("blon"))


POINTS = ("alat", "alon", "blat", "blon")


def _points():
    return [F.col(c) for c in POINTS]


def spanned(spark, sf) -> DataFrame:
    return pairs(spark, sf).withColumn("km", geodesy.haversine(*_points()))


def r6(c):
    return F.round(c, 6)


# Geodesy


@query("haversine", f"WITH {_H} SELECT k, round(km, 6) AS km FROM h")
def _(spark, sf):
    return spanned(spark, sf).select("k", r6("km").alias("km"))


@query("haversine_debug", f"WITH {_H} SELECT k, round(radians(blat) - radians(alat), 6) AS delta_lat, round(radians(blon) - radians(alon), 6) AS delta_lon, round(ha, 6) AS a, round(hc, 6) AS c FROM h")
def _(spark, sf):
    return pairs(spark, sf).select("k", geodesy.haversine_debug(*_points()).alias("d")).select("k", *[r6(f"d.{n}").alias(n) for n in ("delta_lat", "delta_lon", "a", "c")])


_F, _A, _B = geodesy.WGS84_F, geodesy.WGS84_A, geodesy.WGS84_B
_V = f"""WITH RECURSIVE {_P}, c AS (SELECT *, atan((1 - {_F!r}) * tan(radians(alat))) AS u1, atan((1 - {_F!r}) * tan(radians(blat))) AS u2, radians(blon - alon) AS l FROM p),
 g AS (SELECT k, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l, alat = blat AND alon = blon AS same FROM c),
 it AS (SELECT k, s1, c1, s2, c2, l, l AS lam, 0 AS n, same AS done, 0::DOUBLE AS ss, 1::DOUBLE AS cs, 0::DOUBLE AS sg, 1::DOUBLE AS ca, 0::DOUBLE AS cm FROM g
  UNION ALL
  SELECT k, s1, c1, s2, c2, l, nl AS lam, n + 1, (n >= 1 AND abs(nl - lam) < 1e-12) OR ss = 0 AS done, ss, cs, sg, ca, cm FROM (
   SELECT *, l + (1 - cc) * {_F!r} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS nl FROM (
    SELECT *, cs - 2 * s1 * s2 / (CASE WHEN ca <> 0 THEN ca ELSE 1e-16 END) AS cm, {_F!r} / 16 * ca * (4 + {_F!r} * (4 - 3 * ca)) AS cc FROM (
     SELECT *, 1 - sa * sa AS ca, atan2(ss, cs) AS sg FROM (
      SELECT *, c1 * c2 * sin(lam) / greatest(ss, 1e-16) AS sa FROM (
       SELECT k, s1, c1, s2, c2, l, lam, n, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs
       FROM it WHERE NOT done AND n < 200)))))),
 e AS (SELECT *, ca * {(_A**2 - _B**2) / _B**2!r} AS q FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS rn FROM it) WHERE rn = 1),
 w AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS aa, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS bb FROM e),
 v AS (SELECT k, done, n, CASE WHEN NOT done THEN NULL WHEN ss = 0 THEN 0 ELSE {_B!r} * aa * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) / 1000 END AS km FROM w)"""


@query("vincenty", f"{_V} SELECT k, round(km, 5) AS km FROM v")
def _(spark, sf):
    return pairs(spark, sf).select("k", F.round(geodesy.vincenty(*_points()).km, 5).alias("km"))


@query("vincenty_converged", f"{_V} SELECT done AS converged, count(*) AS n FROM v GROUP BY 1")
def _(spark, sf):
    return pairs(spark, sf).select(geodesy.vincenty(*_points()).converged.alias("converged")).groupBy("converged").agg(F.count("*").alias("n"))


@query("exact_distance", f"{_V}, hh AS (SELECT p.k, 6371.0088 * 2 * atan2(sqrt({_HAV_A}), sqrt(greatest(1 - ({_HAV_A}), 0))) AS hk FROM p) SELECT v.k, round(coalesce(km, hk), 5) AS km, CASE WHEN km IS NULL THEN 'haversine' ELSE 'vincenty' END AS method FROM v JOIN hh ON v.k = hh.k")
def _(spark, sf):
    return pairs(spark, sf).select("k", geodesy.exact_distance(*_points()).alias("d")).select("k", F.round("d.km", 5).alias("km"), "d.method")


_WRAP = "(((blon - alon + 540) % 360 + 360) % 360 - 180)"


@query("wrap_delta_lon", f"WITH {_P} SELECT k, round({_WRAP}, 6) AS d FROM p")
def _(spark, sf):
    return pairs(spark, sf).select("k", r6(geodesy.wrap_delta_lon(F.col("alon"), F.col("blon"))).alias("d"))


_LAT = "(111132.92 - 559.82 * cos(2 * radians({x})) + 1.175 * cos(4 * radians({x})) - 0.0023 * cos(6 * radians({x}))) / 1000"
_LON = "(111412.84 * cos(radians({x})) - 93.5 * cos(3 * radians({x})) + 0.118 * cos(5 * radians({x}))) / 1000"


@query("deg_len", f"WITH {_P} SELECT k, round({_LAT.format(x='alat')}, 6) AS lat_km, round({_LON.format(x='alat')}, 6) AS lon_km FROM p")
def _(spark, sf):
    return pairs(spark, sf).select("k", r6(geodesy.deg_len_lat(F.col("alat"))).alias("lat_km"), r6(geodesy.deg_len_lon(F.col("alat"))).alias("lon_km"))


_ANGLE = f"acos(least(1, greatest(-1, sin(radians(alat)) * sin(radians(blat)) + cos(radians(alat)) * cos(radians(blat)) * cos(radians({_WRAP})))))"


@query("central_angle", f"WITH {_P} SELECT k, round({_ANGLE}, 6) AS angle FROM p")
def _(spark, sf):
    return pairs(spark, sf).select("k", r6(geodesy.central_angle(*_points())).alias("angle"))


_STEP = "CASE WHEN {x} < 100 THEN 10 WHEN {x} < 1000 THEN 50 WHEN {x} < 5000 THEN 100 WHEN {x} < 10000 THEN 200 ELSE 250 END"
_SMALL = f"(abs(blat - alat) <= 30 AND abs({_WRAP}) <= 30 AND abs(0.5 * (alat + blat)) <= 60)"
_GUT = f"{_P}, g AS (SELECT *, {_SMALL} AS small, 0.5 * (alat + blat) AS mid, CASE WHEN {_SMALL} THEN sqrt(pow({_LAT.format(x='(0.5 * (alat + blat))')} * abs(blat - alat), 2) + pow({_LON.format(x='(0.5 * (alat + blat))')} * abs({_WRAP}), 2)) ELSE 6371.0088 * {_ANGLE} END AS approx FROM p)"


@query("coarse_round", f"WITH {_H}, s AS (SELECT k, km, {_STEP.format(x='km')} AS step, {u('jitter')} AS u FROM h) SELECT k, greatest(round_even((km + (u * 0.7 - 0.35) * step) / step, 0) * step, step)::BIGINT AS ballpark, step FROM s")
def _(spark, sf):
    d = Draws(F.col("k"))
    return spanned(spark, sf).select("k", geodesy.coarse_round(F.col("km"), d.uniform("jitter")).alias("ballpark"), geodesy.coarse_step(F.col("km")).alias("step"))


@query("gutcheck", f"WITH {_GUT} SELECT k, small, round(approx, 5) AS approx_km FROM g")
def _(spark, sf):
    return pairs(spark, sf).select("k", geodesy.gutcheck(*_points()).alias("g")).select("k", "g.small", F.round("g.approx_km", 5).alias("approx_km"))


@query("long_arc", f"WITH {_P}, a AS (SELECT k, {_ANGLE} AS x FROM p) SELECT k, round(degrees(x), 6) AS angle_deg, round(degrees(x) / 360 * 100, 6) AS frac_pct, round(degrees(x) / 360 * 2 * pi() * 6371.0088, 4) AS circle_fraction_km FROM a")
def _(spark, sf):
    return pairs(spark, sf).select("k", geodesy.long_arc(geodesy.central_angle(*_points())).alias("a")).select("k", r6("a.angle_deg").alias("angle_deg"), r6("a.frac_pct").alias("frac_pct"), F.round("a.circle_fraction_km", 4).alias("circle_fraction_km"))


@query("intuition_gap", f"WITH {_H}, s AS (SELECT k, km, round(km / 100) * 100 AS approx FROM h) SELECT k, round(abs(km - approx), 5) AS diff_km, round(100 * abs(km - approx) / km, 5) AS diff_pct FROM s WHERE km > 0")
def _(spark, sf):
    out = spanned(spark, sf).where("km > 0").withColumn("g", geodesy.intuition_gap(F.col("km"), F.round(F.col("km") / 100) * 100))
    return out.select("k", F.round("g.diff_km", 5).alias("diff_km"), F.round("g.diff_pct", 5).alias("diff_pct"))


# Coordinates

_DMS0 = f"{_P}, d0 AS (SELECT k, alat AS v, floor(abs(alat)) AS d, (abs(alat) - floor(abs(alat))) * 60 AS r FROM p), d1 AS (SELECT k, v, d, floor(r) AS m, round((r - floor(r)) * 60, 2) AS s FROM d0), d2 AS (SELECT k, v, d, m + CASE WHEN s >= 60 THEN 1 ELSE 0 END AS m, CASE WHEN s >= 60 THEN 0 ELSE s END AS s FROM d1), dms AS (SELECT k, v, (d + CASE WHEN m >= 60 THEN 1 ELSE 0 END)::INT AS deg, (CASE WHEN m >= 60 THEN 0 ELSE m END)::INT AS min, s AS sec, CASE WHEN v >= 0 THEN 1 ELSE -1 END AS sign FROM d2)"
_DMM0 = f"{_P}, m0 AS (SELECT k, alat AS v, floor(abs(alat)) AS d, round((abs(alat) - floor(abs(alat))) * 60, 3) AS m FROM p), dmm AS (SELECT k, v, (d + CASE WHEN m >= 60 THEN 1 ELSE 0 END)::INT AS deg, CASE WHEN m >= 60 THEN 0 ELSE m END AS min, CASE WHEN v >= 0 THEN 1 ELSE -1 END AS sign FROM m0)"


@query("to_dms", f"WITH {_DMS0} SELECT k, deg, min, round(sec, 2) AS sec, sign FROM dms")
def _(spark, sf):
    return pairs(spark, sf).select("k", coords.to_dms(F.col("alat")).alias("c")).select("k", "c.deg", "c.min", F.round("c.sec", 2).alias("sec"), "c.sign")


@query("to_dmm", f"WITH {_DMM0} SELECT k, deg, round(min, 3) AS min, sign FROM dmm")
def _(spark, sf):
    return pairs(spark, sf).select("k", coords.to_dmm(F.col("alat")).alias("c")).select("k", "c.deg", F.round("c.min", 3).alias("min"), "c.sign")


@query("dms_to_dd", f"WITH {_DMS0} SELECT k, round((deg + min / 60.0::DOUBLE + sec / 3600) * sign, 6) AS dd FROM dms")
def _(spark, sf):
    return pairs(spark, sf).select("k", r6(coords.dms_to_dd(coords.to_dms(F.col("alat")))).alias("dd"))


@query("dmm_to_dd", f"WITH {_DMM0} SELECT k, round((deg + min / 60) * sign, 6) AS dd FROM dmm")
def _(spark, sf):
    return pairs(spark, sf).select("k", r6(coords.dmm_to_dd(coords.to_dmm(F.col("alat")))).alias("dd"))


@query("format_dd", f"WITH {_P} SELECT k, format('{{:.6f}}, {{:.6f}}', alat, alon) AS text FROM p")
def _(spark, sf):
    return pairs(spark, sf).select("k", coords.format_dd(F.col("alat"), F.col("alon")).alias("text"))


@query("format_dms", f"WITH {_DMS0} SELECT k, format('{{}}° {{}}′ {{:.2f}}″ {{}}', deg, min, sec, CASE WHEN sign > 0 THEN 'N' ELSE 'S' END) AS lat FROM dms")
def _(spark, sf):
    return pairs(spark, sf).select("k", F.split(coords.format_dms(F.col("alat"), F.col("alon")), ", ")[0].alias("lat"))


@query("format_dmm", f"WITH {_DMM0} SELECT k, format('{{}}° {{:.3f}}′ {{}}', deg, min, CASE WHEN sign > 0 THEN 'N' ELSE 'S' END) AS lat FROM dmm")
def _(spark, sf):
    return pairs(spark, sf).select("k", F.split(coords.format_dmm(F.col("alat"), F.col("alon")), ", ")[0].alias("lat"))


# Units

_SPELLINGS = sorted({s for own in phrases.UNIT_VARIANTS.values() for s in own} | {"", "  Nautical  Miles", "n.mi", "parsec", "statute-mile", "Sea Mile"})


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_SPELL = f"s0 AS (SELECT k, {_listed(_SPELLINGS)}[(k % {len(_SPELLINGS)} + 1)::INT] AS raw FROM (SELECT o_orderkey AS k FROM orders)), s AS (SELECT k, raw, lower(trim(raw)) AS t, regexp_replace(lower(trim(raw)), '[\\s.\\-_/]+', '', 'g') AS c FROM s0)"


def spelled(spark, sf) -> DataFrame:
    return orders(spark, sf).withColumn("raw", F.element_at(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col("k") % len(_SPELLINGS) + 1).cast("int")))


def _in(col: str, words) -> str:
    return f"{col} IN ({', '.join(chr(39) + w + chr(39) for w in words)})"


_CONVERT = f"CASE WHEN {_in('lower(raw)', units.CONVERT_KM)} THEN 'km' WHEN {_in('lower(raw)', units.CONVERT_NMI)} THEN 'nmi' WHEN {_in('lower(raw)', units.CONVERT_MI)} THEN 'mi' ELSE 'km' END"
_USER_UNIT = "CASE WHEN raw = '' THEN NULL WHEN contains(c, 'seamile') OR contains(t, 'sea mile') OR contains(t, 'naut') OR contains(c, 'nmi') OR c = 'nm' THEN 'nmi' WHEN contains(t, 'statute') OR contains(c, 'statutemile') OR contains(t, 'mile') OR regexp_matches(t, '\\bmi\\b') OR c IN ('m', 'sm') THEN 'mi' WHEN contains(c, 'km') OR contains(t, 'klick') OR contains(t, 'click') OR c = 'k' OR contains(t, 'meter') OR contains(t, 'metre') THEN 'km' END"


@query("convert_km", f"WITH {_H}, {_SPELL} SELECT h.k, {_CONVERT} AS unit, round(km / CASE {_CONVERT} WHEN 'mi' THEN 1.609344 WHEN 'nmi' THEN 1.852 ELSE 1 END, 5) AS value FROM h JOIN s ON h.k = s.k")
def _(spark, sf):
    out = spanned(spark, sf).withColumn("raw", F.element_at(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col("k") % len(_SPELLINGS) + 1).cast("int")))
    return out.select("k", units.convert_km(F.col("km"), F.col("raw")).alias("c")).select("k", "c.unit", F.round("c.value", 5).alias("value"))


@query("to_km", f"WITH {_H} SELECT k, round(km * CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 1.609344 ELSE 1.852 END, 5) AS km FROM h")
def _(spark, sf):
    unit = F.when(F.col("k") % 3 == 0, "km").when(F.col("k") % 3 == 1, "mi").otherwise("nmi")
    return spanned(spark, sf).select("k", F.round(units.to_km(F.col("km"), unit), 5).alias("km"))


@query("normalize_user_unit", f"WITH {_SPELL} SELECT k, raw, {_USER_UNIT} AS unit FROM s")
def _(spark, sf):
    return spelled(spark, sf).select("k", "raw", units.normalize_user_unit(F.col("raw")).alias("unit"))


@query("unit_origin", f"WITH {_SPELL} SELECT k, CASE WHEN {_USER_UNIT} IS NULL THEN 'default' WHEN t IN ('m', 'm.') THEN 'ambiguous' ELSE 'explicit' END AS origin FROM s")
def _(spark, sf):
    return spelled(spark, sf).select("k", units.unit_origin(F.col("raw")).alias("origin"))


@query("normalize_unit", f"WITH {_SPELL} SELECT k, CASE WHEN raw = '' THEN NULL WHEN {_in('t', units.ANSWER_KM)} OR {_in('c', units.ANSWER_KM)} THEN 'km' WHEN {_in('t', units.ANSWER_MI)} OR {_in('c', units.ANSWER_MI)} OR contains(t, 'statute') THEN 'mi' WHEN {_in('t', units.ANSWER_NMI)} OR {_in('c', units.ANSWER_NMI)} OR contains(t, 'sea') THEN 'nmi' END AS unit FROM s")
def _(spark, sf):
    return spelled(spark, sf).select("k", units.normalize_unit(F.col("raw")).alias("unit"))


@query("unit_preference", f"WITH {_SPELL}, q AS (SELECT k, lower('how far in ' || raw || '?') AS q FROM s) SELECT k, CASE WHEN contains(q, 'sea mile') OR contains(q, 'nm') OR contains(q, 'nautical') OR contains(q, 'n.m.') THEN 'nmi' WHEN contains(q, 'click') OR contains(q, 'klick') THEN 'km' WHEN contains(q, ' mile') OR contains(q, '(mi') OR contains(q, 'statute') THEN 'mi' WHEN contains(q, ' km') OR contains(q, 'kilometer') OR contains(q, 'kilometre') THEN 'km' END AS unit FROM q")
def _(spark, sf):
    return spelled(spark, sf).select("k", units.unit_preference(F.concat(F.lit("how far in "), F.col("raw"), F.lit("?"))).alias("unit"))


# Sampling


@query("random_coord", f"WITH p AS (SELECT o_orderkey AS k FROM orders) SELECT k, round(-89.5 + 179.0 * {u('A:lat')}, 9) AS lat, round(-179.5 + 359.0 * {u('A:lon')}, 9) AS lon FROM p")
def _(spark, sf):
    lat, lon = Draws(F.col("k")).coord("A")
    return orders(spark, sf).select("k", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("choose_uniform", f"WITH p AS (SELECT o_orderkey AS k FROM orders) SELECT k, ['DD', 'DMS', 'DMM'][(floor({u('fmt')} * 3) + 1)::INT] AS fmt FROM p")
def _(spark, sf):
    return orders(spark, sf).select("k", Draws(F.col("k")).choose(generate.FORMATS, "fmt").alias("fmt"))


@query("weighted_choice", f"WITH p AS (SELECT o_orderkey AS k FROM orders), d AS (SELECT k, {u('unit')} AS u FROM p) SELECT k, CASE WHEN u <= 0.6 THEN 'km' WHEN u <= 0.95 THEN 'mi' ELSE 'nmi' END AS unit FROM d")
def _(spark, sf):
    return orders(spark, sf).select("k", Draws(F.col("k")).weighted(phrases.DEFAULT_UNIT, "unit").alias("unit"))


@query("bernoulli", f"WITH p AS (SELECT o_orderkey AS k FROM orders) SELECT k, {u('analysis')} < 0.8 AS hit FROM p")
def _(spark, sf):
    return orders(spark, sf).select("k", Draws(F.col("k")).maybe(0.8, "analysis").alias("hit"))


@query("sample_k", "WITH p AS (SELECT o_orderkey AS k FROM orders), e AS (SELECT k, x, ('0x' || substr(md5('0:' || k || ':s:' || (i - 1)), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM p, (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS x, unnest(range(1, 6)) AS i)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY u) AS n FROM e) SELECT k, string_agg(x, ',' ORDER BY n) AS xs FROM r WHERE n <= 2 GROUP BY k")
def _(spark, sf):
    return orders(spark, sf).select("k", F.array_join(Draws(F.col("k")).sample(F.array(*[F.lit(x) for x in "abcde"]), 2, "s"), ",").alias("xs"))


# Noise

_TEXT = "'12° 34.567′ N, 8° 9.01″ W'"


def _pick(options, slot: str) -> str:
    return f"{_listed(options)}[(floor({u(slot)} * {len(options)}) + 1)::INT]"


def _mark_sql(text: str) -> str:
    for mark, key, options in (("′", "p_coord_replace_prime", noise.PRIMES), ("″", "p_coord_replace_dblprime", noise.DOUBLE_PRIMES), ("°", "p_coord_drop_deg", noise.DEGREES)):
        text = f"CASE WHEN {u(key)} < {noise.NOISE[key]} THEN replace({text}, '{mark}', {_pick(options, key + ':to')}) ELSE {text} END"
    return text


@query("noise_marks", f"WITH p AS (SELECT o_orderkey AS k FROM orders) SELECT k, {_mark_sql(_TEXT)} AS text FROM p")
def _(spark, sf):
    return orders(spark, sf).select("k", noise.noise_marks(F.lit(_TEXT[1:-1]), Draws(F.col("k"))).alias("text"))


def _spacing_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace({text}, '\\s+', ' ', 'g'), '\\s*,\\s*', {_pick(noise.COMMAS, 'comma')}, 'g')"
    for old, options in (("° ", noise.AFTER_DEGREE), (" ′", noise.BEFORE_PRIME), (" ″", noise.BEFORE_DOUBLE)):
        out = f"replace({out}, '{old}', {_pick(options, 'space:' + old.strip())})"
    spaced = f"CASE WHEN {u('p_coord_extra_spaces')} < 0.4 THEN {out} ELSE {text} END"
    return f"SELECT k, CASE WHEN {u('p_coord_remove_comma')} < 0.2 THEN replace(t, ',', {_pick(noise.NO_COMMAS, 'nocomma')}) ELSE t END AS text FROM (SELECT k, {spaced} AS t FROM p)"


@query("noise_spacing", f"WITH p AS (SELECT o_orderkey AS k FROM orders) {_spacing_sql(_TEXT)}")
def _(spark, sf):
    return orders(spark, sf).select("k", noise.noise_spacing(F.lit(_TEXT[1:-1]), Draws(F.col("k"))).alias("text"))


@query("noise_hemi", f"WITH p AS (SELECT o_orderkey AS k FROM orders) SELECT k, CASE WHEN {u('hemi')} < 0.05 THEN regexp_replace({_TEXT}, 'N', '') ELSE {_TEXT} END AS text, {u('hemi')} < 0.05 AS dropped FROM p")
def _(spark, sf):
    return orders(spark, sf).select("k", noise.noise_hemi(F.lit(_TEXT[1:-1]), Draws(F.col("k")), each=False).alias("h")).select("k", "h.text", "h.dropped")


@query("noisy_coord")
def _(spark, sf):
    d = Draws(F.col("k"))
    out = pairs(spark, sf).withColumn("fmt", d.choose(generate.FORMATS, "fmt"))
    return out.select("k", "fmt", noise.noisy_coord(F.col("alat"), F.col("alon"), F.col("fmt"), d, "a:").alias("c")).select("k", "fmt", "c.text", "c.dropped")


@query("inject_typos")
def _(spark, sf):
    return orders(spark, sf).select("k", noise.inject_typos(F.lit(phrases.SYSTEM), Draws(F.col("k")), 0.5).alias("text"))


@query("apply_caps")
def _(spark, sf):
    return orders(spark, sf).select("k", noise.apply_caps(F.lit(phrases.SYSTEM), Draws(F.col("k")), 0.5).alias("text"))


@query("format_variation")
def _(spark, sf):
    text = F.lit("Heading\n- one\n- two\nmore\n\nlast")
    return orders(spark, sf).select("k", noise.format_variation(text, Draws(F.col("k")), {"p_collapse_all": 0.2, "p_collapse_some": 0.4, "collapse_some_fraction_range": [0.2, 0.5], "p_compact_bullets": 0.5}).alias("text"))


# Texts


@query("template_fill", "SELECT o_orderkey AS k, 'from ' || o_orderkey || ' by ' || o_orderstatus || ' {other}' AS text FROM orders")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("k"), phrases.fill("from {key} by {status} {other}", {"key": F.col("o_orderkey"), "status": F.col("o_orderstatus")}).alias("text"))


@query("intent_recap")
def _(spark, sf):
    d = Draws(F.col("k"))
    raw = F.element_at(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col("k") % len(_SPELLINGS) + 1).cast("int"))
    unit = F.coalesce(units.normalize_user_unit(raw), F.lit("km"))
    return pairs(spark, sf).select("k", prompts.intent_recap(unit, units.unit_origin(raw), raw, (F.col("alat"), F.col("alon")), (F.col("blat"), F.col("blon")), d, phrases.BANK).alias("text"))


@query("narrate_distance", f"WITH {_H} SELECT k, format('Sphere of 6371.0088 km; angle {{:.4f}} rad; distance {{:.1f}} km = {{:.1f}} km.', hc, km, km) AS text FROM h")
def _(spark, sf):
    out = pairs(spark, sf).withColumn("d", geodesy.haversine_debug(*_points()))
    return out.select("k", prompts.narrate_distance(F.lit("haversine"), F.col("d.km"), F.lit("km"), F.col("d.c"), F.lit(0), True).alias("text"))


def _prompt(weights):
    def run(spark, sf):
        d = Draws(F.col("k"))
        p = prompts.user_prompt(F.lit("1.5, 2.5"), F.lit("3.5, 4.5"), d, weights, phrases.BANK)
        return orders(spark, sf).select("k", p.alias("p")).select("k", "p.text", "p.raw_unit", "p.mode")

    return run


query("user_prompt_eval")(_prompt(prompts.EVAL_WEIGHTS))
query("user_prompt_train")(_prompt(prompts.TRAIN_WEIGHTS))


@query("user_prompt_mode", f"WITH p AS (SELECT o_orderkey AS k FROM orders), m AS (SELECT {_listed(prompts.MODES)}[(floor({u('user:mode')} * 6) + 1)::INT] AS mode FROM p) SELECT mode, count(*) AS n FROM m GROUP BY 1")
def _(spark, sf):
    return QUERIES["user_prompt_eval"](spark, sf).groupBy("mode").agg(F.count("*").alias("n"))


def _rows(spark, sf) -> int:
    return spark.read.parquet(f"{sf}/customer.parquet").count()


@query("gen_eval_set")
def _(spark, sf):
    return generate.eval_set(spark, _rows(spark, sf), seed=7)


@query("gen_train_set")
def _(spark, sf):
    return generate.train_set(spark, _rows(spark, sf), seed=7)


@query("gen_eval_formats", f"WITH p AS (SELECT row_number() OVER () - 1 AS k FROM customer) SELECT ['DD', 'DMS', 'DMM'][(floor({u('fmt', 7)} * 3) + 1)::INT] AS fmt, count(*) AS n FROM p GROUP BY 1")
def _(spark, sf):
    return QUERIES["gen_eval_set"](spark, sf).groupBy("fmt").agg(F.count("*").alias("n"))


@query("gen_eval_truth", f"WITH q AS (SELECT row_number() OVER () - 1 AS k FROM customer), p AS (SELECT k, -89.5 + 179.0 * {u('A:lat', 7)} AS alat, -179.5 + 359.0 * {u('A:lon', 7)} AS alon, -89.5 + 179.0 * {u('B:lat', 7)} AS blat, -179.5 + 359.0 * {u('B:lon', 7)} AS blon FROM q) SELECT k AS idx, round(6371.0088 * 2 * atan2(sqrt({_HAV_A}), sqrt(greatest(1 - ({_HAV_A}), 0))), 5) AS expected_km FROM p")
def _(spark, sf):
    return QUERIES["gen_eval_set"](spark, sf).select("idx", F.round("expected_km", 5).alias("expected_km"))


@query("render_analysis")
def _(spark, sf):
    return QUERIES["gen_train_set"](spark, sf).select("idx", "analysis")


@query("render_final")
def _(spark, sf):
    return QUERIES["gen_train_set"](spark, sf).select("idx", "final")


@query("peek_messages")
def _(spark, sf):
    return QUERIES["gen_train_set"](spark, sf).select("idx", F.explode(messages.peek(F.col("messages"))).alias("line"))


_TURNS = "SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN text END, chr(1) ORDER BY turn) AS s, string_agg(CASE WHEN role = 'user' THEN text END, chr(1) ORDER BY turn) AS us, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(1) ORDER BY turn) AS a FROM conversations GROUP BY conv_id"


def conversations(spark, sf) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    each = F.struct("turn", "role", F.when(F.col("role") == "assistant", "final").alias("channel"), F.col("text").alias("content"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("turns"))


@query("harmony_row", f"SELECT conv_id, split_part(s, chr(1), 1) AS developer, split_part(us, chr(1), 1) AS \"user\", split_part(a, chr(1), 1) AS final FROM ({_TURNS})".replace("split_part(s, chr(1), 1)", "CASE WHEN s IS NOT NULL THEN split_part(s, chr(1), 1) END").replace("split_part(us, chr(1), 1)", "CASE WHEN us IS NOT NULL THEN split_part(us, chr(1), 1) END").replace("split_part(a, chr(1), 1)", "CASE WHEN a IS NOT NULL THEN split_part(a, chr(1), 1) END"))
def _(spark, sf):
    return conversations(spark, sf).select("conv_id", messages.harmony_row(F.col("turns")).alias("r")).select("conv_id", "r.developer", "r.user", "r.final")


def _messages(spark, sf) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))


_HIGH = messages.HINTS["high"].replace("'", "''").replace("\n", "' || chr(10) || '")


@query("render_harmony", f"SELECT conv_id, string_agg('<|start|>' || role || '<|message|>' || text || CASE WHEN role = 'system' THEN '{_HIGH}' ELSE '' END || '<|end|>', '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return _messages(spark, sf).select("conv_id", messages.render_harmony(F.col("m"), F.lit("high")).alias("prompt"))


@query("render_naive", r"SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || regexp_replace(text, '\s+$', ''), chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '[ASSISTANT]' || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return _messages(spark, sf).select("conv_id", messages.render_naive(F.col("m")).alias("prompt"))


_HINT_SQL = " ".join(f"WHEN '{n}' THEN {len(h)}" for n, h in messages.HINTS.items())


@query("effort_hint", f"SELECT o_orderkey AS k, CASE ['low', 'medium', 'high', 'none'][(o_orderkey % 4 + 1)::INT] {_HINT_SQL} ELSE 0 END AS n FROM orders")
def _(spark, sf):
    effort = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "none")]), (F.col("k") % 4 + 1).cast("int"))
    return orders(spark, sf).select("k", F.length(messages.effort_hint(effort)).alias("n"))


@query("build_messages", f"SELECT o_orderkey AS k, 'system:' || o_orderpriority || '|user:' || o_orderstatus || {messages.CONCISE!r} AS text FROM orders".replace("\\n", "' || chr(10) || '"))
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    built = messages.build_messages(F.col("o_orderpriority"), F.col("o_orderstatus"), concise=True)
    return rows.select(F.col("o_orderkey").alias("k"), F.array_join(F.transform(built, lambda m: F.concat(m.role, F.lit(":"), m.content)), "|").alias("text"))


# Channels

_RAW_SQL = f"{_H}, raw AS (SELECT k, km, CASE k % 4 WHEN 0 THEN '<analysis> about ' || k || ' </analysis><FINAL> ' || k || ' km </FINAL>' WHEN 1 THEN 'assistantanalysis: think ' || k || ' assistantfinal ' || k || ' km' WHEN 2 THEN '  about ' || k || ' km' ELSE '<|channel|>analysis<|message|>hm ' || k || '<|end|><|channel|>final<|message|> ' || k || ' km<|return|>' END AS raw FROM h)"


def raw_outputs(spark, sf) -> DataFrame:
    key = F.col("k").cast("string")
    four = F.col("k") % 4
    text = (
        F.when(four == 0, F.concat(F.lit("<analysis> about "), key, F.lit(" </analysis><FINAL> "), key, F.lit(" km </FINAL>")))
        .when(four == 1, F.concat(F.lit("assistantanalysis: think "), key, F.lit(" assistantfinal "), key, F.lit(" km")))
        .when(four == 2, F.concat(F.lit("  about "), key, F.lit(" km")))
        .otherwise(F.concat(F.lit("<|channel|>analysis<|message|>hm "), key, F.lit("<|end|><|channel|>final<|message|> "), key, F.lit(" km<|return|>")))
    )
    return spanned(spark, sf).withColumn("raw", text)


@query("extract_tag", f"WITH {_RAW_SQL} SELECT k, CASE WHEN k % 4 = 0 THEN trim(regexp_extract(raw, '(?is)<\\s*final\\s*>(.*?)<\\s*/\\s*final\\s*>', 1)) END AS final FROM raw")
def _(spark, sf):
    return raw_outputs(spark, sf).select("k", channels.extract_tag(F.col("raw"), "final").alias("final"))


@query("split_channels_tags", f"WITH {_RAW_SQL} SELECT k, CASE k % 4 WHEN 2 THEN trim(raw) ELSE k || ' km' END AS final, CASE k % 4 WHEN 0 THEN 'about ' || k WHEN 1 THEN 'think ' || k END AS analysis FROM raw WHERE k % 4 <> 3")
def _(spark, sf):
    return raw_outputs(spark, sf).where("k % 4 <> 3").select("k", channels.split_channels_tags(F.col("raw")).alias("c")).select("k", "c.final", "c.analysis")


@query("extract_channel", f"WITH {_RAW_SQL} SELECT k, CASE WHEN k % 4 = 3 THEN 'hm ' || k END AS analysis FROM raw")
def _(spark, sf):
    return raw_outputs(spark, sf).select("k", channels.extract_channel(F.col("raw"), channels.ANALYSIS_MARK).alias("analysis"))


@query("split_channels_harmony", f"WITH {_RAW_SQL} SELECT k, CASE WHEN k % 4 = 3 THEN k || ' km' ELSE '' END AS final, CASE WHEN k % 4 = 3 THEN 'hm ' || k END AS analysis FROM raw")
def _(spark, sf):
    return raw_outputs(spark, sf).select("k", channels.split_channels_harmony(F.col("raw")).alias("c")).select("k", "c.final", "c.analysis")


@query("truncate_channel", f"WITH {_RAW_SQL} SELECT k, substr(raw, 1, 12) AS text FROM raw")
def _(spark, sf):
    return raw_outputs(spark, sf).select("k", channels.truncated(F.col("raw"), 12).alias("text"))


# Numbers

_NUM_TEXT = "'about ' || k || '.5 km, or 1,' || (100 + k % 900) || ' miles; 30 min, 7 kms'"
_PY_NUMBER = numbers.NUMBER.replace("(?iuU)", "(?i)").replace(" ", "").replace(" ", "").replace("'", "''").replace("’", "")


def number_texts(spark, sf) -> DataFrame:
    key = F.col("k").cast("string")
    return orders(spark, sf).withColumn("text", F.concat(F.lit("about "), key, F.lit(".5 km, or 1,"), (100 + F.col("k") % 900).cast("string"), F.lit(" miles; 30 min, 7 kms")))


@query("number_spans", f"WITH p AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT k, {_NUM_TEXT} AS text FROM p), m AS (SELECT k, text, regexp_extract_all(text, '{_PY_NUMBER}', 1) AS nums, regexp_extract_all(text, '{_PY_NUMBER}', 2) AS us FROM t), e AS (SELECT k, text, unnest(nums) AS num, unnest(us) AS u FROM m) SELECT k, num, nullif(u, '') AS unit, (CASE WHEN u = 'kms' THEN instr(text, '7 kms') WHEN num = '30' THEN instr(text, '30 min') ELSE instr(text, num) END - 1)::INT AS start FROM e")
def _(spark, sf):
    return number_texts(spark, sf).select("k", F.explode(numbers.number_spans(F.col("text"))).alias("m")).select("k", "m.num", "m.unit", "m.start")


_NUMERALS = ("5", "1,234", "9.330", "1,234.5", "1.234,5", "1,234,567", "12.5, 40.2", "-7", "0.5", "12 345", "13,25", "1'234", "1.234.567", "12.")
_NUM_SQL = f"n AS (SELECT k, {_listed(_NUMERALS)}[(k % {len(_NUMERALS)} + 1)::INT] AS num FROM (SELECT o_orderkey AS k FROM orders)), c AS (SELECT k, num, replace(replace(num, ' ', ''), '''', '') AS s FROM n)"
_READ = "CASE WHEN contains(s, '.') AND contains(s, ',') AND len(s) - instr(reverse(s), '.') > len(s) - instr(reverse(s), ',') THEN [replace(s, ',', '')] WHEN contains(s, '.') AND contains(s, ',') THEN [replace(replace(s, '.', ''), ',', '.')] WHEN regexp_full_match(s, '\\d+,\\d{3}') THEN [replace(s, ',', '.'), replace(s, ',', '')] WHEN contains(s, ',') THEN [replace(s, ',', '.')] WHEN regexp_full_match(s, '\\d+\\.\\d{3}') THEN [s, replace(s, '.', '')] ELSE [s] END"


def numerals(spark, sf) -> DataFrame:
    return orders(spark, sf).withColumn("num", F.element_at(F.array(*[F.lit(x) for x in _NUMERALS]), (F.col("k") % len(_NUMERALS) + 1).cast("int")))


@query("parse_number", f"WITH {_NUM_SQL}, v AS (SELECT k, abs(try_cast(unnest({_READ}) AS DOUBLE)) AS v FROM c) SELECT k, v FROM v WHERE v IS NOT NULL")
def _(spark, sf):
    return numerals(spark, sf).select("k", F.explode(numbers.parse_number(F.col("num"))).alias("v"))


@query("parse_float_locale", f"WITH {_NUM_SQL} SELECT k, abs(try_cast(CASE WHEN contains(s, '.') AND contains(s, ',') AND len(s) - instr(reverse(s), '.') > len(s) - instr(reverse(s), ',') THEN replace(s, ',', '') WHEN contains(s, '.') AND contains(s, ',') THEN replace(replace(s, '.', ''), ',', '.') WHEN regexp_full_match(s, '[+-]?\\d{{1,3}}(,\\d{{3}})+') THEN replace(s, ',', '') WHEN contains(s, ',') THEN replace(s, ',', '.') WHEN regexp_full_match(s, '[+-]?\\d{{1,3}}(\\.\\d{{3}})+') THEN replace(s, '.', '') ELSE s END AS DOUBLE)) AS v FROM c")
def _(spark, sf):
    return numerals(spark, sf).select("k", numbers.parse_float_locale(F.col("num")).alias("v"))


@query("near_any", f"WITH p AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT k, {_NUM_TEXT} AS text, k % 40 AS pos FROM p) SELECT k, regexp_matches(lower(substr(text, greatest(pos - 5, 0)::BIGINT + 1, (pos + 5 - greatest(pos - 5, 0))::BIGINT)), 'km|mile') AS near FROM t")
def _(spark, sf):
    return number_texts(spark, sf).select("k", numbers.near_any(F.col("text"), (F.col("k") % 40).cast("int"), 5, ("km", "mile")).alias("near"))


# Outputs of a model for scoring: the true distance times a keyed error, in a keyed unit; every bucket occurs.

_FACTOR = f"(CASE WHEN {u('err')} < 0.4 THEN 1.001 WHEN {u('err')} < 0.6 THEN 1.03 WHEN {u('err')} < 0.8 THEN 1.07 ELSE 1.4 END)"
_OUT = f"{_H}, o AS (SELECT k, km, CASE k % 3 WHEN 0 THEN 'km' WHEN 1 THEN 'mi' ELSE 'nmi' END AS unit, floor(km * {_FACTOR} / CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 1.609344 ELSE 1.852 END)::BIGINT AS n FROM h)"
_PRED = "n * CASE unit WHEN 'mi' THEN 1.609344 WHEN 'nmi' THEN 1.852 ELSE 1 END"
_RESULT = f"{_OUT}, q AS (SELECT *, abs({_PRED} - km) / km AS rel FROM o WHERE km > 0), b AS (SELECT *, CASE WHEN rel < 0.01 THEN 'perfect' WHEN rel < 0.05 THEN 'approx' WHEN rel < 0.1 THEN 'pretty_close' ELSE 'wrong' END AS bucket, CASE WHEN rel < 0.01 THEN 10 WHEN rel < 0.05 THEN 3 WHEN rel < 0.1 THEN 1 ELSE 0 END AS points FROM q)"


def evals(spark, sf) -> DataFrame:
    return spanned(spark, sf).where("km > 0").select(F.col("k").alias("idx"), F.lit(phrases.SYSTEM).alias("developer"), F.lit("how far is it in km?").alias("user"), F.col("km").alias("expected_km"))


def outputs(spark, sf) -> DataFrame:
    err = Draws(F.col("k")).uniform("err")
    factor = F.when(err < 0.4, 1.001).when(err < 0.6, 1.03).when(err < 0.8, 1.07).otherwise(1.4)
    unit = F.when(F.col("k") % 3 == 0, "km").when(F.col("k") % 3 == 1, "mi").otherwise("nmi")
    divisor = F.when(F.col("k") % 3 == 0, 1.0).when(F.col("k") % 3 == 1, geodesy.KM_PER_MILE).otherwise(geodesy.KM_PER_NAUTICAL_MILE)
    n = F.floor(F.col("km") * factor / divisor).cast("bigint").cast("string")
    return spanned(spark, sf).where("km > 0").select(F.col("k").alias("idx"), F.concat(F.lit("<analysis>some steps</analysis><final>The distance is about "), n, F.lit(" "), unit, F.lit("</final>")).alias("model_output_raw"))


def results(spark, sf, **options) -> DataFrame:
    return score.score(evals(spark, sf), outputs(spark, sf), **options)


@query("score_join", f"WITH {_RESULT} SELECT k AS idx, n::DOUBLE AS parsed_value, unit AS parsed_unit_norm, round({_PRED}, 5) AS parsed_km, bucket, points FROM b")
def _(spark, sf):
    return results(spark, sf).select("idx", "parsed_value", "parsed_unit_norm", F.round("parsed_km", 5).alias("parsed_km"), "bucket", "points")


@query("score_join_missing", f"WITH {_RESULT} SELECT k AS idx, CASE WHEN k % 3 = 0 THEN 'wrong' ELSE bucket END AS bucket, CASE WHEN k % 3 = 0 THEN 0 ELSE points END AS points FROM b")
def _(spark, sf):
    some = outputs(spark, sf).where("idx % 3 <> 0")
    return score.score(evals(spark, sf), some).select("idx", "bucket", "points")


@query("bucket_points", f"WITH {_RESULT} SELECT k AS idx, bucket, points, round(rel, 6) AS rel_error FROM b")
def _(spark, sf):
    return results(spark, sf).select("idx", "bucket", "points", F.round("rel_error", 6).alias("rel_error"))


@query("summary", f"WITH {_RESULT} SELECT count(*) AS n, count_if(bucket = 'perfect')::BIGINT AS perfect, count_if(bucket = 'approx')::BIGINT AS approx, count_if(bucket = 'pretty_close')::BIGINT AS pretty_close, count_if(bucket = 'wrong')::BIGINT AS wrong, sum(points)::BIGINT AS total_points, round(sum(points) / count(*), 9) AS points_per_sample FROM b")
def _(spark, sf):
    return score.summary(results(spark, sf)).withColumn("points_per_sample", F.round("points_per_sample", 9))


@query("bucket_counts", f"WITH {_RESULT} SELECT count_if(bucket = 'perfect')::BIGINT AS perfect, count_if(bucket = 'approx')::BIGINT AS approx, count_if(bucket = 'pretty_close')::BIGINT AS pretty_close, count_if(bucket = 'wrong')::BIGINT AS wrong FROM b")
def _(spark, sf):
    return score.summary(results(spark, sf)).select(*score.BUCKETS)


@query("bucket_rates", f"WITH {_RESULT} SELECT round(avg((bucket = 'perfect')::INT), 9) AS perfect_rate, round(avg((bucket = 'approx')::INT), 9) AS approx_rate, round(avg((bucket = 'pretty_close')::INT), 9) AS pretty_close_rate, round(avg((bucket = 'wrong')::INT), 9) AS wrong_rate FROM b")
def _(spark, sf):
    return score.summary(results(spark, sf), rates=True).select(*[F.round(f"{b}_rate", 9).alias(f"{b}_rate") for b in score.BUCKETS])


@query("limit_rows", f"WITH {_RESULT} SELECT k AS idx, bucket FROM b ORDER BY k LIMIT 100")
def _(spark, sf):
    return results(spark, sf).select("idx", "bucket").orderBy("idx").limit(100)


@query("gt_boost", f"WITH {_RESULT}, r AS (SELECT k, least(abs(n - km), abs(n * 1.609344 - km), abs(n * 1.852 - km)) / km AS best FROM b) SELECT k AS idx, CASE WHEN best < 0.01 THEN 6 WHEN best < 0.05 THEN 3 WHEN best < 0.1 THEN 1 END AS close_to_gt FROM r")
def _(spark, sf):
    return results(spark, sf).select("idx", F.col("score_breakdown.close_to_gt").alias("close_to_gt"))


@query("feature_scores", f"WITH {_RESULT} SELECT k AS idx, 5 AS unit_bonus, 3 AS near_keyword, 2 AS finalish, 2 AS tail_bias, CASE WHEN n < 5 THEN -1 END AS tiny_penalty FROM b")
def _(spark, sf):
    return results(spark, sf).select("idx", *[f"score_breakdown.{n}" for n in ("unit_bonus", "near_keyword", "finalish", "tail_bias", "tiny_penalty")])


# Several numbers in a text, two of them bare: extraction, ranking and unit resolution.

_BARE = "'First ' || (k % 97 + 5) || ' then 6371 km earth radius, so the answer is ' || (k % 13 + 100)"


def bare_texts(spark, sf) -> DataFrame:
    text = F.concat(F.lit("First "), (F.col("k") % 97 + 5).cast("string"), F.lit(" then 6371 km earth radius, so the answer is "), (F.col("k") % 13 + 100).cast("string"))
    return orders(spark, sf).withColumn("text", text)


_CAND = f"""p AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT k, {_BARE} AS text FROM p), c AS (
 SELECT k, (k % 97 + 5)::DOUBLE AS v, NULL AS unit, 6 AS start, text FROM t UNION ALL
 SELECT k, 6371::DOUBLE, 'km', instr(text, '6371') - 1, text FROM t UNION ALL
 SELECT k, (k % 13 + 100)::DOUBLE, NULL, instr(text, 'answer is ') + 9, text FROM t),
 w AS (SELECT *, lower(substr(text, greatest(start - 80, 0) + 1, start + 80 - greatest(start - 80, 0))) AS w80, lower(substr(text, greatest(start - 40, 0) + 1, start + 40 - greatest(start - 40, 0))) AS w40,
  lower(substr(text, greatest(start - 30, 0) + 1, start + 30 - greatest(start - 30, 0))) AS w30 FROM c),
 x AS (SELECT k, v, unit, start::INT AS start, CASE WHEN unit IS NULL THEN 0 ELSE 5 END + 3 + 2 + CASE WHEN contains(w40, 'answer') THEN 2 ELSE 0 END
  - CASE WHEN contains(w30, 'rad') THEN 4 ELSE 0 END - CASE WHEN contains(w40, 'earth radius') OR contains(w40, '6371 km') THEN 6 ELSE 0 END AS score FROM w)"""


@query("extract_candidates", f"WITH {_CAND} SELECT k, v AS raw_value, unit AS unit_norm, start, score FROM x")
def _(spark, sf):
    return bare_texts(spark, sf).select("k", F.explode(numbers.extract_candidates(F.col("text"))).alias("c")).select("k", "c.raw_value", "c.unit_norm", "c.start", "c.score")


@query("rank_candidates", f"WITH {_CAND} SELECT k, string_agg(start, ',' ORDER BY score DESC, start DESC, v DESC) AS starts FROM x GROUP BY k")
def _(spark, sf):
    ranked = numbers.rank_candidates(numbers.extract_candidates(F.col("text")))
    return bare_texts(spark, sf).select("k", F.array_join(F.transform(ranked, lambda c: c.start.cast("string")), ",").alias("starts"))


@query("top_candidate", f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, start DESC, v DESC) AS n FROM x) SELECT k, v AS raw_value, score FROM r WHERE n = 1")
def _(spark, sf):
    return bare_texts(spark, sf).select("k", F.get(numbers.rank_candidates(numbers.extract_candidates(F.col("text"))), F.lit(0)).alias("c")).select("k", "c.raw_value", "c.score")


@query("pack_median", f"WITH {_CAND}, y AS (SELECT k, unnest([v, v * 1.609344, v * 1.852]) AS km FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY km) AS n FROM y) SELECT k, round(km, 6) AS median FROM r WHERE n = 5")
def _(spark, sf):
    return bare_texts(spark, sf).select("k", r6(numbers.pack_median(numbers.rank_candidates(numbers.extract_candidates(F.col("text"))))).alias("median"))


@query("resolve_unit", f"WITH {_CAND}, y AS (SELECT k, unnest([v, v * 1.609344, v * 1.852]) AS km FROM x), m AS (SELECT k, km AS med FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY km) AS n FROM y) WHERE n = 5), t1 AS (SELECT k, v, unit FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, start DESC, v DESC) AS n FROM x) WHERE n = 1), z AS (SELECT t1.k, unit, u.u AS cand, v * u.f AS km, row_number() OVER (PARTITION BY t1.k ORDER BY abs(v * u.f - med), u.i) AS n FROM t1 JOIN m ON t1.k = m.k CROSS JOIN (VALUES ('km', 1.0::DOUBLE, 0), ('mi', 1.609344, 1), ('nmi', 1.852, 2)) u(u, f, i)) SELECT k, coalesce(unit, cand) AS unit, round(km, 6) AS km FROM z WHERE n = 1")
def _(spark, sf):
    ranked = numbers.rank_candidates(numbers.extract_candidates(F.col("text")))
    out = bare_texts(spark, sf).withColumn("ranked", ranked).withColumn("p", score.picked(F.col("ranked"), F.lit(None).cast("string")))
    return out.select("k", "p.resolved.unit", r6("p.resolved.km").alias("km"))


@query("dedup_candidates", f"WITH {_CAND} SELECT k, count(DISTINCT (v, unit, start)) AS n FROM x GROUP BY k")
def _(spark, sf):
    twice = F.concat(numbers.extract_candidates(F.col("text")), numbers.extract_candidates(F.col("text")))
    return bare_texts(spark, sf).select("k", F.size(numbers.dedup_candidates(twice)).cast("bigint").alias("n"))


@query("choose_candidate", f"WITH {_RESULT} SELECT k AS idx, n::DOUBLE AS value, unit, k % 2 = 0 AS used_analysis_fallback FROM b")
def _(spark, sf):
    # every second answer has its number in the analysis alone
    out = evals(spark, sf).join(outputs(spark, sf), "idx").withColumn("c", channels.split_channels_tags(F.col("model_output_raw")))
    out = out.withColumns({"final": F.when(F.col("idx") % 2 == 0, "see above").otherwise(F.col("c.final")), "analysis": F.when(F.col("idx") % 2 == 0, F.col("c.final")).otherwise("nothing")})
    return score.choose_candidate(out).select("idx", F.col("choice.top.raw_value").alias("value"), F.col("choice.resolved.unit").alias("unit"), "used_analysis_fallback")


@query("score_channel_variant", f"WITH {_RESULT} SELECT bucket, count(*) AS n FROM b GROUP BY bucket")
def _(spark, sf):
    marked = outputs(spark, sf).withColumn("model_output_raw", F.concat(F.lit(channels.FINAL_MARK), F.regexp_extract("model_output_raw", "<final>(.*)</final>", 1), F.lit("<|return|>")))
    return score.score(evals(spark, sf), marked, score.CHANNEL).groupBy("bucket").agg(F.count("*").alias("n"))


@query("decision_trace")
def _(spark, sf):
    return results(spark, sf, with_trace=True).select("idx", "trace")
