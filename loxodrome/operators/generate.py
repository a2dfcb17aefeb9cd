"""Evaluation and training tables from a row key and a seed; one narrow stage each, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, geodesy, noise, phrases, prompts, units
from ..functions.messages import harmony_row
from ..functions.sampling import Draws

FORMATS = ("DD", "DMS", "DMM")
P_ANALYSIS = 0.80


def _drawn(rows: DataFrame, seed: int, each: bool) -> tuple[DataFrame, Draws]:
    """Adds fmt, two coordinates and their noisy texts `a` and `b` to rows with an `idx`."""
    d = Draws(F.col("idx"), seed)
    (alat, alon), (blat, blon) = d.coord("A"), d.coord("B")
    out = rows.withColumns({"fmt": d.choose(FORMATS, "fmt"), "alat": alat, "alon": alon, "blat": blat, "blon": blon})
    noisy = lambda p: noise.noisy_coord(F.col(f"{p}lat"), F.col(f"{p}lon"), F.col("fmt"), d, f"coord:{p}:", each=each)
    return out.withColumns({"a": noisy("a"), "b": noisy("b")}), d


def eval_set(spark: SparkSession, n: int, seed: int = 0, bank: dict | None = None) -> DataFrame:
    """n rows idx, developer, user, expected_km, expected_value, expected_unit, fmt, alat, alon, blat, blon."""
    out, d = _drawn(spark.range(n).withColumnRenamed("id", "idx"), seed, each=False)
    out = out.withColumn("prompt", prompts.user_prompt(F.col("a.text"), F.col("b.text"), d, prompts.EVAL_WEIGHTS, bank or phrases.BANK))
    unit = F.coalesce(units.normalize_user_unit(F.col("prompt.raw_unit")), F.lit("mi"))
    out = out.withColumn("expected_km", geodesy.haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))
    out = out.withColumn("expected", units.convert_km(F.col("expected_km"), unit))
    user = noise.inject_typos(F.col("prompt.text"), d, noise.NOISE["p_user_typos"], "typo:user")
    return out.select("idx", F.lit(phrases.SYSTEM).alias("developer"), user.alias("user"), "expected_km", F.col("expected.value").alias("expected_value"), F.col("expected.unit").alias("expected_unit"), "fmt", "alat", "alon", "blat", "blon")


def train_set(spark: SparkSession, n: int, seed: int = 0, analysis_ratio: float = P_ANALYSIS, distance_model: str = "mixed", bank: dict | None = None) -> DataFrame:
    """n rows developer, user, analysis, final, messages. distance_model: mixed, wgs84 or sphere, for rows with an analysis."""
    if distance_model not in ("mixed", "wgs84", "sphere"):
        raise ValueError(f"unknown distance model {distance_model}")
    bank = bank or phrases.BANK
    out, d = _drawn(spark.range(n).withColumnRenamed("id", "idx"), seed, each=True)
    out = out.withColumn("prompt", prompts.user_prompt(F.col("a.text"), F.col("b.text"), d, prompts.TRAIN_WEIGHTS, bank))
    raw = F.col("prompt.raw_unit")
    has = d.maybe(analysis_ratio, "analysis")
    vincenty = {"mixed": d.uniform("method") >= 0.5, "wgs84": F.lit(True), "sphere": F.lit(False)}[distance_model]
    out = out.withColumns({"unit": F.coalesce(units.normalize_user_unit(raw), d.weighted(phrases.DEFAULT_UNIT, "unit")), "origin": units.unit_origin(raw), "has": has, "wants": has & vincenty})
    read = lambda c: F.when(F.col("has"), coords.shown(F.col(c), F.col("fmt"))).otherwise(F.col(c))
    out = out.withColumns({f"d_{c}": read(c) for c in ("alat", "alon", "blat", "blon")})
    points = [F.col(f"d_{c}") for c in ("alat", "alon", "blat", "blon")]
    out = out.withColumns({"gut": geodesy.gutcheck(*points), "sphere": geodesy.haversine_debug(*points), "inverse": F.when(F.col("wants"), geodesy.vincenty(*points))})
    out = out.withColumns({"km": F.coalesce("inverse.km", "sphere.km"), "method": F.when(F.col("inverse.km").isNotNull(), "vincenty").otherwise("haversine"), "ballpark": geodesy.coarse_round(F.col("gut.approx_km"), d.uniform("jitter"))})
    row = {c: F.col(c) for c in ("unit", "origin", "gut", "ballpark", "method", "km", "fmt")} | {
        "raw": raw, "a": (points[0], points[1]), "b": (points[2], points[3]), "exact_a": (F.col("alat"), F.col("alon")), "exact_b": (F.col("blat"), F.col("blon")),
        "angle": F.col("sphere.c"), "iterations": F.coalesce("inverse.iterations", F.lit(0)), "dropped_a": F.col("a.dropped"), "dropped_b": F.col("b.dropped"),
        "fell_back": F.col("wants") & F.col("inverse.km").isNull(), "approx": F.when(F.col("has"), F.col("ballpark").cast("double")),
    }
    out = out.withColumns({"analysis": F.when(F.col("has"), prompts.analysis_text(row, d, bank)), "final": prompts.final_text(row, d, bank)})
    system = noise.apply_caps(noise.inject_typos(F.lit(phrases.SYSTEM), d, noise.NOISE["p_system_typos"], "typo:system"), d, noise.CAPS["p_all_caps_system"], "caps:system")
    user = noise.apply_caps(noise.inject_typos(F.col("prompt.text"), d, noise.NOISE["p_user_typos"], "typo:user"), d, noise.CAPS["p_all_caps_user"], "caps:user")
    turn = lambda role, channel, content: F.struct(F.lit(role).alias("role"), F.lit(channel).cast("string").alias("channel"), content.alias("content"))
    turns = F.array(turn("system", None, system), turn("user", None, user), turn("assistant", "analysis", F.col("analysis")), turn("assistant", "final", F.col("final")))
    return out.select("idx", harmony_row(turns).alias("r")).select("idx", "r.*")
