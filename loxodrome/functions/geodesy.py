"""Distances on the sphere and the WGS-84 ellipsoid as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in km, WGS-84 semi-major axis in m and flattening, km in a mile and in a nautical mile.
EARTH_RADIUS_KM = 6371.0088
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
KM_PER_MILE = 1.609344
KM_PER_NAUTICAL_MILE = 1.852

MAX_ROUNDS, SPELL, TOLERANCE = 200, 8, 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once for `body`; without it every mention would be a copy of the whole expression."""
    return F.transform(F.array(value), body)[0]


def haversine_debug(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct of the great-circle distance `km` and the quantities on the way to it."""
    lat1_rad, lon1_rad, lat2_rad, lon2_rad = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    delta_lat, delta_lon = lat2_rad - lat1_rad, lon2_rad - lon1_rad
    a = F.pow(F.sin(delta_lat / 2), 2) + F.cos(lat1_rad) * F.cos(lat2_rad) * F.pow(F.sin(delta_lon / 2), 2)
    base = F.struct(lat1_rad.alias("lat1_rad"), lon1_rad.alias("lon1_rad"), lat2_rad.alias("lat2_rad"), lon2_rad.alias("lon2_rad"), delta_lat.alias("delta_lat"), delta_lon.alias("delta_lon"), a.alias("a"))

    def close(s: Column) -> Column:
        c = 2 * F.atan2(F.sqrt(s.a), F.sqrt(F.greatest(1 - s.a, F.lit(0.0))))
        return F.struct(F.lit(EARTH_RADIUS_KM).alias("R_km"), *[s[n].alias(n) for n in ("lat1_rad", "lon1_rad", "lat2_rad", "lon2_rad", "delta_lat", "delta_lon", "a")], c.alias("c"), (EARTH_RADIUS_KM * c).alias("km"))

    return let(base, close)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    lat1, lon1, lat2, lon2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct km (null if the iteration doesn't settle), converged, iterations, sigma, delta_sigma: the inverse problem on WGS-84.

    The iteration is a fold over a fixed number of rounds whose state stands still once it has settled.
    """
    f = WGS84_F
    u1, u2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    fixed = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("L"))
    names = ("lam", "rounds", "done", "zero", "ss", "cs", "sigma", "ca", "cm")

    def solve(k: Column) -> Column:
        start = F.struct(k.L.alias("lam"), F.lit(0).alias("rounds"), F.lit(False).alias("done"), F.lit(False).alias("zero"), *[F.lit(0.0).alias(n) for n in names[4:]])

        def step(s: Column) -> Column:
            sl, cl = F.sin(s.lam), F.cos(s.lam)
            first = F.struct(F.sqrt(F.pow(k.c2 * sl, 2) + F.pow(k.c1 * k.s2 - k.s1 * k.c2 * cl, 2)).alias("ss"), (k.s1 * k.s2 + k.c1 * k.c2 * cl).alias("cs"), (k.c1 * k.c2 * sl).alias("sa"))

            def second(t: Column) -> Column:
                sin_alpha = t.sa / F.greatest(t.ss, F.lit(1e-16))
                return let(F.struct(t.ss.alias("ss"), t.cs.alias("cs"), F.atan2(t.ss, t.cs).alias("sigma"), sin_alpha.alias("sa"), (1 - sin_alpha * sin_alpha).alias("ca")), third)

            def third(t: Column) -> Column:
                cm = t.cs - 2 * k.s1 * k.s2 / F.when(t.ca != 0, t.ca).otherwise(1e-16)
                c = f / 16 * t.ca * (4 + f * (4 - 3 * t.ca))
                return let(F.struct(*[t[n].alias(n) for n in ("ss", "cs", "sigma", "sa", "ca")], cm.alias("cm"), c.alias("c")), fourth)

            def fourth(t: Column) -> Column:
                following = k.L + (1 - t.c) * f * t.sa * (t.sigma + t.c * t.ss * (t.cm + t.c * t.cs * (2 * F.pow(t.cm, 2) - 1)))
                zero = t.ss == 0
                settled = zero | ((s.rounds >= 1) & (F.abs(following - s.lam) < TOLERANCE))
                return F.struct(following.alias("lam"), (s.rounds + 1).alias("rounds"), settled.alias("done"), zero.alias("zero"), t.ss.alias("ss"), t.cs.alias("cs"), t.sigma.alias("sigma"), t.ca.alias("ca"), t.cm.alias("cm"))

            return let(first, second)

        # in spells, so that a state that has settled stands still for few of them instead of for each round
        rounds = lambda s, n, once: F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, lambda x, _: F.when(x.done, x).otherwise(once(x)))
        return let(rounds(start, MAX_ROUNDS // SPELL, lambda s: rounds(s, SPELL, step)), finish)

    def finish(s: Column) -> Column:
        square = s.ca * ((WGS84_A**2 - WGS84_B**2) / WGS84_B**2)
        series = F.struct((1 + square / 16384 * (4096 + square * (-768 + square * (320 - 175 * square)))).alias("A"), (square / 1024 * (256 + square * (-128 + square * (74 - 47 * square)))).alias("B"))

        def close(t: Column) -> Column:
            delta = t.B * s.ss * (s.cm + t.B / 4 * (s.cs * (2 * F.pow(s.cm, 2) - 1) - t.B / 6 * s.cm * (4 * F.pow(s.ss, 2) - 3) * (4 * F.pow(s.cm, 2) - 3)))
            return let(F.struct(delta.alias("d"), t.A.alias("A")), lambda e: F.struct(F.when(s.zero, 0.0).when(s.done, WGS84_B * e.A * (s.sigma - e.d) / 1000).alias("km"), s.done.alias("converged"), s.rounds.alias("iterations"), F.when(s.zero, 0.0).otherwise(s.sigma).alias("sigma"), F.when(s.zero, 0.0).otherwise(e.d).alias("delta_sigma")))

        return let(series, close)

    same = (lat1 == lat2) & (lon1 == lon2)
    none = F.struct(F.lit(0.0).alias("km"), F.lit(True).alias("converged"), F.lit(0).alias("iterations"), F.lit(0.0).alias("sigma"), F.lit(0.0).alias("delta_sigma"))
    return F.when(same, none).otherwise(let(fixed, solve))


def exact_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct km, method: the ellipsoidal distance, or the spherical one where its iteration doesn't settle."""
    return let(vincenty(lat1, lon1, lat2, lon2).km, lambda v: F.struct(F.coalesce(v, haversine(lat1, lon1, lat2, lon2)).alias("km"), F.when(v.isNull(), "haversine").otherwise("vincenty").alias("method")))


def wrap_delta_lon(lon1: Column, lon2: Column) -> Column:
    """Difference of longitudes in [-180, 180)."""
    return F.pmod(lon2 - lon1 + 540.0, F.lit(360.0)) - 180.0


def deg_len_lat(phi: Column) -> Column:
    """km in a degree of latitude."""
    x = F.radians(phi)
    return (111132.92 - 559.82 * F.cos(2 * x) + 1.175 * F.cos(4 * x) - 0.0023 * F.cos(6 * x)) / 1000


def deg_len_lon(phi: Column) -> Column:
    """km in a degree of longitude."""
    x = F.radians(phi)
    return (111412.84 * F.cos(x) - 93.5 * F.cos(3 * x) + 0.118 * F.cos(5 * x)) / 1000


def central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Central angle in radians by the spherical law of cosines."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(wrap_delta_lon(lon1, lon2))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(d))))


def coarse_step(km: Column) -> Column:
    size = F.abs(km)
    return F.when(size < 100, 10).when(size < 1000, 50).when(size < 5000, 100).when(size < 10000, 200).otherwise(250)


def coarse_round(km: Column, u: Column) -> Column:
    """Ballpark of a distance: jittered by up to 0.35 steps (`u` in [0, 1)), rounded half to even, one step at least."""
    step = coarse_step(km)
    rounded = (F.rint((km + (u * 0.7 - 0.35) * step) / step) * step).cast("bigint")
    return F.when(rounded <= 0, step.cast("bigint")).otherwise(rounded)


def gutcheck(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct small, dlat, dlon, mid_lat, ns_km, ew_km, angle, approx_km: flat-grid estimate for short spans, else the central angle."""
    base = F.struct(F.abs(lat2 - lat1).alias("dlat"), F.abs(wrap_delta_lon(lon1, lon2)).alias("dlon"), (0.5 * (lat1 + lat2)).alias("mid_lat"), central_angle(lat1, lon1, lat2, lon2).alias("angle"))

    def close(s: Column) -> Column:
        small = (s.dlat <= 30) & (s.dlon <= 30) & (F.abs(s.mid_lat) <= 60)
        ns, ew = deg_len_lat(s.mid_lat) * s.dlat, deg_len_lon(s.mid_lat) * s.dlon
        return F.struct(small.alias("small"), s.dlat.alias("dlat"), s.dlon.alias("dlon"), s.mid_lat.alias("mid_lat"), ns.alias("ns_km"), ew.alias("ew_km"), s.angle.alias("angle"), F.when(small, F.sqrt(ns * ns + ew * ew)).otherwise(EARTH_RADIUS_KM * s.angle).alias("approx_km"))

    return let(base, close)


def long_arc(angle: Column) -> Column:
    """Struct of what a long arc's angle (radians) means: degrees, share of the circle, km."""
    around = 2 * math.pi * EARTH_RADIUS_KM
    degrees = F.degrees(angle)
    return F.struct(degrees.alias("angle_deg"), (degrees / 360 * 100).alias("frac_pct"), F.lit(around / 36).alias("per10deg_km"), F.lit(around / 2).alias("half_circum_km"), (degrees / 360 * around).alias("circle_fraction_km"))


def intuition_gap(exact_km: Column, approx_km: Column) -> Column:
    """Struct diff_km, diff_pct of a ballpark; null without one or for no distance."""
    diff = F.abs(exact_km - approx_km)
    return F.when(approx_km.isNotNull() & (exact_km > 0), F.struct(diff.alias("diff_km"), (100 * diff / exact_km).alias("diff_pct")))
