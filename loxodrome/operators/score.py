"""Scoring of model outputs: split channels, extract and choose a number, convert, bucket, summarize."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import channels, numbers, units

BUCKETS = ("perfect", "approx", "pretty_close", "wrong")


@dataclass(frozen=True)
class Variant:
    """What differs between outputs with tags and outputs with channel marks."""

    name: str
    tail_chars: int
    dotted_nautical: bool

    def split(self, raw: Column) -> Column:
        return channels.split_channels_tags(raw) if self.name == "tag" else channels.split_channels_harmony(raw)


TAG = Variant("tag", 480, True)
CHANNEL = Variant("channel", 400, False)
VARIANTS = {v.name: v for v in (TAG, CHANNEL)}


def picked(ranked: Column, preference: Column) -> Column:
    """Struct top, unit, km of ranked candidates; null without any."""
    top = F.get(ranked, F.lit(0))
    return F.when(F.size(ranked) > 0, F.struct(top.alias("top"), numbers.resolve_unit(top, preference, numbers.pack_median(ranked)).alias("resolved")))


def choose_candidate(df: DataFrame, variant: Variant = TAG, use_truth_boost: bool = True, final: str = "final", analysis: str = "analysis", user: str = "user", expected: str = "expected_km") -> DataFrame:
    """Adds `choice`: struct top, resolved (unit, km); and `used_analysis_fallback`.

    The final text's best candidate, unless its score is 0 or less and the analysis has a better one; the end of the final text
    if neither has any. Each text's candidates are extracted once, as a column of their own.
    """
    rank = lambda text: numbers.rank_candidates(numbers.boosted(numbers.extract_candidates(text), F.col(expected)) if use_truth_boost else numbers.extract_candidates(text))
    tail = F.when(F.size("_final") == 0, F.right(F.col(final), F.lit(variant.tail_chars)))
    has_analysis = F.coalesce(F.col(analysis), F.lit("")) != ""
    weak = (F.size("_final") == 0) | (F.get("_final", F.lit(0)).score <= 0)
    out = df.withColumn("_prefer", units.unit_preference(F.col(user), variant.dotted_nautical)).withColumn("_final", rank(F.coalesce(F.col(final), F.lit(""))))
    out = out.withColumn("_analysis", F.when(weak & has_analysis, rank(F.col(analysis)))).withColumn("_tail", rank(F.coalesce(tail, F.lit(""))))
    better = F.coalesce((F.size("_analysis") > 0) & ((F.size("_final") == 0) | (F.get("_analysis", F.lit(0)).score > F.get("_final", F.lit(0)).score)), F.lit(False))
    chosen = F.when(better, F.col("_analysis")).when(F.size("_final") > 0, F.col("_final")).otherwise(F.col("_tail"))
    out = out.withColumn("used_analysis_fallback", better).withColumn("_chosen", chosen)
    return out.withColumn("choice", picked(F.col("_chosen"), F.col("_prefer"))).drop("_prefer", "_final", "_analysis", "_tail", "_chosen")


def trace(choice: Column) -> Column:
    """One line on why a candidate was chosen."""
    top = choice.top
    return F.when(choice.isNull(), "no numeric candidate").otherwise(F.format_string("value=%s unit=%s assumed=%s km=%s score=%s span=[%s,%s]", top.raw_value.cast("string"), F.coalesce(top.unit_raw, F.lit("-")), choice.resolved.unit, choice.resolved.km.cast("string"), top.score.cast("string"), top.start.cast("string"), top["end"].cast("string")))


def score(evals: DataFrame, outputs: DataFrame, variant: Variant = TAG, use_truth_boost: bool = True, with_trace: bool = False, how: str = "left") -> DataFrame:
    """Results of `evals` (idx, developer, user, expected_km, ...) with `outputs` (idx, model_output_raw), joined by idx.

    A row without an output counts as a wrong answer, unless `how` is "inner" (for streams of outputs, that score what has come).
    """
    split = evals.join(outputs, "idx", how).withColumn("model_output_raw", F.coalesce("model_output_raw", F.lit(""))).withColumn("_split", variant.split(F.col("model_output_raw"))).withColumns({"final": F.col("_split.final"), "analysis": F.col("_split.analysis")})
    out = choose_candidate(split, variant, use_truth_boost)
    result = numbers.bucket_points(F.col("expected_km"), F.col("choice.resolved.km"))
    out = out.withColumn("_result", result)
    top = F.col("choice.top")
    columns = {
        "parsed_value": top.raw_value,
        "parsed_unit_raw": top.unit_raw,
        "parsed_unit_norm": top.unit_norm,
        "assumed_unit_for_match": F.col("choice.resolved.unit"),
        "parsed_km": F.col("choice.resolved.km"),
        "rel_error": F.col("_result.rel_error"),
        "bucket": F.col("_result.bucket"),
        "points": F.col("_result.points"),
        "score_breakdown": top.score_detail,
        "span_start": top.start,
        "span_end": top["end"],
    }
    extra = [F.col(c) for c in ("model_input_rendered", "final_seen_in_pass1", "forced_final_inserted") if c in out.columns]
    kept = [F.col(c) for c in ("idx", "developer", "user")] + extra + [F.col("model_output_raw"), F.col("final").alias("model_output_final"), F.col("analysis").alias("model_output_analysis"), F.col("expected_km")]
    named = [c.alias(n) for n, c in columns.items()]
    return out.select(*kept, *named, F.col("used_analysis_fallback"), *([trace(F.col("choice")).alias("trace")] if with_trace else []))


def unmatched(evals: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs whose idx is none of `evals`: they belong to another evaluation set."""
    return outputs.join(evals.select("idx"), "idx", "left_anti")


def summary(results: DataFrame, rates: bool = False) -> DataFrame:
    """One row: n, a count for each bucket, total_points, points_per_sample, and perhaps each bucket's share. One row per task is shuffled."""
    counts = results.agg(F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS], F.coalesce(F.sum("points"), F.lit(0)).alias("total_points"))
    n = F.greatest(F.col("n"), F.lit(1))
    out = counts.withColumn("points_per_sample", F.col("total_points") / n)
    return out.withColumns({f"{b}_rate": F.col(b) / n for b in BUCKETS}) if rates else out


def generated(evals: DataFrame, generate, batch: int = 8) -> DataFrame:
    """Outputs (idx, model_output_raw) of `generate(list of prompts) -> list of texts`, called for up to `batch` rows of `evals` (idx, prompt) at a time."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield part[["idx"]].assign(model_output_raw=generate(part["prompt"].tolist()))

    return evals.select("idx", "prompt").mapInPandas(run, evals.select("idx").schema.add("model_output_raw", "string"))


def token_budget(most: int, fraction: float | None = None, budget: int = 1000) -> int:
    """Tokens of the first of two generation passes."""
    return max(1, min(most, int(most * fraction) if fraction is not None and 0 < fraction < 1 else budget))
