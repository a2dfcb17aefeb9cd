"""Scoring of a stream of model outputs; the core holds no state, so the same expressions serve both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import BUCKETS, TAG, Variant, score


def score_stream(outputs: DataFrame, evals: DataFrame, variant: Variant = TAG) -> DataFrame:
    """Results of a stream of outputs (idx, model_output_raw) joined with a stored evaluation set."""
    return score(evals, outputs, variant, how="inner")


def running_summary(results: DataFrame) -> DataFrame:
    """Counts and points so far, for the complete output mode."""
    return results.groupBy().agg(F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS], F.sum("points").alias("total_points"))


def write_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
