"""The command line end to end, and a stream of outputs scored like a stored table."""

import json

from pyspark.sql import functions as F

from loxodrome import cli
from loxodrome.operators import generate, score
from loxodrome.sources import io, schemas
from loxodrome.streaming import scoring


def answers(evals):
    return evals.select("idx", F.concat(F.lit("<final>"), F.format_string("%.1f", "expected_km"), F.lit(" km</final>")).alias("model_output_raw"))


def test_cli(spark, tmp_path, capsys):
    out = {n: str(tmp_path / n) for n in ("eval", "train", "outputs", "results", "summary.json")}
    assert cli.main(["gen-eval", "--n", "12", "--seed", "4", "--out", out["eval"]]) == 0
    assert cli.main(["gen-train", "--n", "3", "--out", out["train"], "--distance-model", "sphere", "--no-preview"]) == 0
    assert io.read_training(spark, out["train"]).count() == 3
    io.write_table(answers(io.read_eval_set(spark, out["eval"])), out["outputs"], schemas.OUTPUTS)
    assert cli.main(["score", "--eval-file", out["eval"], "--outputs", out["outputs"], "--out", out["results"], "--summary", out["summary.json"], "--limit", "10"]) == 0
    assert json.loads((tmp_path / "summary.json").read_text())["n"] == 10
    again = io.write_summary(score.summary(spark.read.parquet(out["results"]), rates=True), out["summary.json"], clobber=False)
    assert again.name != "summary.json" and "perfect_rate" in json.loads(again.read_text())


def test_stream(spark, tmp_path):
    evals = generate.eval_set(spark, 20, seed=2).cache()
    io.write_table(answers(evals), str(tmp_path / "outputs"), schemas.OUTPUTS)
    stream = spark.readStream.schema(schemas.OUTPUTS).parquet(str(tmp_path / "outputs"))
    scoring.write_results(scoring.score_stream(stream, evals), str(tmp_path / "results"), str(tmp_path / "state")).awaitTermination(120)
    stored = score.score(evals, io.read_outputs(spark, str(tmp_path / "outputs")))
    key = lambda df: sorted(map(tuple, df.select("idx", "bucket", "points", "parsed_km").collect()))
    assert key(spark.read.parquet(str(tmp_path / "results"))) == key(stored)
