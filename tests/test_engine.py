"""Hand-derived values of the engine's operators."""

import math

import pytest
from pyspark.sql import functions as F

from loxodrome.functions import channels, coords, geodesy, messages, noise, numbers, phrases, units
from loxodrome.functions.sampling import Draws
from loxodrome.operators import generate, score
from loxodrome.sources import io, schemas


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*values):
    return [F.lit(float(v)) for v in values]


@pytest.mark.parametrize(("points", "km"), [((0, 0, 0, 90), 10007.557221), ((0, 0, 1, 0), 111.195080), ((0, 0, 0, 180), 20015.114442), ((3, 4, 3, 4), 0.0)])
def test_haversine(spark, points, km):
    assert one(spark, geodesy.haversine(*lits(*points))) == pytest.approx(km, abs=1e-6)


@pytest.mark.parametrize(("points", "km"), [((0, 10, 0, 50), 4452.779632), ((0, 0, 90, 0), 10001.965729), ((0, 0, 1, 0), 110.574389), ((1, 2, 1, 2), 0.0), ((0, 0, 0.5, 179.7), None), ((30, 0, -30, 179.9), None)])
def test_vincenty(spark, points, km):
    got = one(spark, geodesy.vincenty(*lits(*points)))
    assert got["converged"] is (km is not None)
    assert got["km"] == (None if km is None else pytest.approx(km, abs=1e-5))
    exact = one(spark, geodesy.exact_distance(*lits(*points)))
    assert exact["method"] == ("haversine" if km is None else "vincenty") and exact["km"] is not None


def test_degrees_and_wrap(spark):
    assert one(spark, geodesy.deg_len_lat(F.lit(0.0))) == pytest.approx(110.574273, abs=1e-5)
    assert one(spark, geodesy.deg_len_lat(F.lit(90.0))) == pytest.approx(111.693917, abs=1e-5)
    assert one(spark, geodesy.deg_len_lon(F.lit(0.0))) == pytest.approx(111.319458, abs=1e-5)
    assert one(spark, geodesy.wrap_delta_lon(*lits(170, -170))) == 20
    assert one(spark, geodesy.central_angle(*lits(0, 0, 0, 180))) == pytest.approx(math.pi)
    assert one(spark, geodesy.coarse_round(F.lit(1.0), F.lit(0.5))) == 10


def test_components(spark):
    assert one(spark, coords.format_dms(*lits(-12.5, 8.25))) == "12° 30′ 0.00″ S, 8° 15′ 0.00″ E"
    assert one(spark, coords.format_dmm(*lits(0.0, -179.5))) == "0° 0.000′ N, 179° 30.000′ W"
    carried = one(spark, coords.to_dms(F.lit(9.9999999)))
    assert (carried["deg"], carried["min"], carried["sec"]) == (10, 0, 0.0)
    assert one(spark, coords.dms_to_dd(coords.to_dms(F.lit(-33.123456)))) == pytest.approx(-33.123456, abs=0.005 / 3600)


@pytest.mark.parametrize(("raw", "unit", "origin"), [("mtr", None, "default"), ("give it to me in m", None, "default"), ("meters", "km", "explicit"), ("n.m.", "nmi", "explicit"), ("n mi", "nmi", "explicit"), ("M", "mi", "ambiguous"), ("m.", "mi", "ambiguous"), ("k", "km", "explicit"), ("", None, "default")])
def test_user_units(spark, raw, unit, origin):
    assert one(spark, units.normalize_user_unit(F.lit(raw))) == unit
    assert one(spark, units.unit_origin(F.lit(raw))) == origin


def test_convert(spark):
    assert one(spark, units.convert_km(F.lit(1.609344), F.lit("MILES")))["value"] == pytest.approx(1)
    assert one(spark, units.convert_km(F.lit(1.852), F.lit("nm"))).asDict() == {"value": pytest.approx(1), "unit": "nmi"}
    assert one(spark, units.convert_km(F.lit(5.0), F.lit(None).cast("string")))["unit"] == "km"


@pytest.mark.parametrize(("km", "bucket", "points"), [(100, "perfect", 10), (100.9, "perfect", 10), (101.5, "approx", 3), (95.5, "approx", 3), (106, "pretty_close", 1), (91, "pretty_close", 1), (111, "wrong", 0), (0, "wrong", 0), (None, "wrong", 0)])
def test_buckets(spark, km, bucket, points):
    got = one(spark, numbers.bucket_points(F.lit(100.0), F.lit(km).cast("double")))
    assert (got["bucket"], got["points"]) == (bucket, points)
    assert one(spark, numbers.bucket_points(F.lit(0.0), F.lit(1.0)))["rel_error"] == math.inf


@pytest.mark.parametrize(("text", "found"), [("5 miles", [("5", "mi")]), ("30 min", [("30", "mi")]), ("7 kms", [("7", "kms")]), ("8 seamile", [("8", "sea")]), ("15e3", [("15", None), ("3", None)]), ("12.5, 40.2", [("12.5, 40.2", None)]), ("none", [])])
def test_number_spans(spark, text, found):
    got = one(spark, numbers.number_spans(F.lit(text)))
    assert [(m["num"], m["unit"]) for m in got] == found
    assert all(text[m["start"] :].startswith(m["num"]) for m in got)


@pytest.mark.parametrize(("num", "readings"), [("1,234", [1.234, 1234]), ("9.330", [9.33, 9330]), ("1,234.5", [1234.5]), ("1.234,5", [1234.5]), ("1,234,567", []), ("12.5, 40.2", []), ("26300\n45", []), ("-7", [7])])
def test_readings(spark, num, readings):
    assert one(spark, numbers.parse_number(F.lit(num))) == readings


@pytest.mark.parametrize(
    ("text", "final", "analysis"),
    [("<analysis>a</analysis><final>12 km</final>", "12 km", "a"), ("assistantanalysis: think assistantfinal 12 km", "12 km", "think"), ("about 12 km", "about 12 km", None)],
)
def test_tags(spark, text, final, analysis):
    got = one(spark, channels.split_channels_tags(F.lit(text)))
    assert (got["final"], got["analysis"]) == (final, analysis)
    assert one(spark, channels.split_channels_harmony(F.lit("about 12 km"))).asDict() == {"final": "", "analysis": None}


def test_draws_are_the_same_for_any_partitioning(spark):
    d = Draws(F.col("id"), 3)
    rows = [sorted(map(tuple, spark.range(200).repartition(n).select("id", d.uniform("a"), d.choose(["x", "y"], "b")).collect())) for n in (1, 2, 8)]
    assert rows[0] == rows[1] == rows[2]
    n = spark.range(4000).where(d.maybe(0.3, "m")).count()
    assert abs(n - 1200) < 5 * math.sqrt(4000 * 0.21)


def test_noise_keeps_digits(spark):
    d = Draws(F.col("id"), 1)
    rows = spark.range(300).select(noise.noisy_coord(F.lit(12.5), F.lit(-8.25), F.lit("DMS"), d, "x:")["text"].alias("t"), noise.inject_typos(F.lit("go 12.5 N from here to there"), d, 1.0).alias("y")).collect()
    assert all("".join(c for c in r["t"] if c.isdigit()) == "1230000815000" for r in rows)
    assert all("12.5 N" in r["y"] and len(r["y"]) >= 27 for r in rows)


def test_messages(spark):
    built = messages.build_messages(F.lit("sys"), F.lit("hello \n"))
    assert one(spark, messages.render_naive(built)) == "[SYSTEM]\nsys\n\n[USER]\nhello\n\n[ASSISTANT]\n"
    assert one(spark, messages.render_harmony(built, F.lit("none"))) == "<|start|>system<|message|>sys<|end|><|start|>user<|message|>hello \n<|end|>"


def test_phrases(tmp_path):
    with pytest.raises(FileNotFoundError):
        phrases.load_required(tmp_path, "x.json")
    (tmp_path / "x.json").write_text("{")
    with pytest.raises(ValueError):
        phrases.load_required(tmp_path, "x.json")
    assert phrases.load_or(tmp_path, "x.json", 5) == 5
    with pytest.raises(KeyError):
        phrases.require_keys({"a": 1}, ["a", "b"])


def test_generate_and_score(spark, tmp_path):
    evals = generate.eval_set(spark, 40, seed=1)
    assert evals.count() == 40 and evals.drop("idx").schema.names == [f.split(" ")[0] for f in schemas.EVAL.split(", ")]
    train = generate.train_set(spark, 40, seed=1).cache()
    assert train.where("size(messages) <> 3 OR final IS NULL OR user IS NULL").count() == 0
    assert 20 <= train.where("analysis IS NOT NULL").count() <= 40
    io.write_table(train, str(tmp_path / "train"), schemas.TRAIN)
    assert io.read_training(spark, str(tmp_path / "train")).count() == 40
    outputs = evals.select("idx", F.concat(F.lit("<final>"), F.format_string("%.1f", "expected_km"), F.lit(" km</final>")).alias("model_output_raw"))
    results = score.score(evals, outputs)
    io.write_table(results, str(tmp_path / "results"), schemas.RESULTS)
    got = score.summary(spark.read.parquet(str(tmp_path / "results"))).first()
    assert got["n"] == 40 and got["perfect"] >= 39
    empty = score.summary(results.where("false")).first()
    assert empty["n"] == 0 and empty["points_per_sample"] == 0


def test_generator_boundary(spark):
    evals = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "idx bigint, prompt string")
    got = score.generated(evals, lambda prompts: [p.upper() for p in prompts], batch=2)
    assert sorted(r["model_output_raw"] for r in got.collect()) == ["P0", "P1", "P2", "P3", "P4"]
    assert (score.token_budget(100, 0.5), score.token_budget(100), score.token_budget(5000)) == (50, 100, 1000)


def test_rows_without_idx_are_numbered_and_none_is_lost(spark, tmp_path):
    from loxodrome.operators import score
    from loxodrome.sources import io

    rows = spark.range(100).selectExpr("'d' AS developer", "concat('how far, km? ', id) AS user", "id + 1D AS expected_km")
    rows.repartition(4).write.parquet(str(tmp_path / "evals"))
    evals = io.read_eval_set(spark, str(tmp_path / "evals"))
    again = {r["idx"]: r["user"] for r in io.read_eval_set(spark, str(tmp_path / "evals")).collect()}
    assert sorted(again) == list(range(100)) and all(again[r["idx"]] == r["user"] for r in evals.collect())
    outputs = evals.where("idx < 60").selectExpr("idx", "concat('<final>', expected_km, ' km</final>') AS model_output_raw")
    got = {r["idx"]: (r["bucket"], r["points"]) for r in score.score(evals, outputs).collect()}
    assert len(got) == 100 and all(got[i] == (("perfect", 10) if i < 60 else ("wrong", 0)) for i in got)
    assert score.unmatched(evals, outputs).count() == 0 and score.unmatched(evals.where("idx > 9"), outputs).count() == 10


def test_the_engine_works_where_the_subpackage_cannot_be_imported():
    import subprocess
    import sys

    said = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", said], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 80


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _catalog(spark, name):
    from loxodrome.plans import catalog

    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["pack_median", "rank_candidates", "resolve_unit", "top_candidate"])
def test_candidates_are_extracted_once_by_many_tasks(spark, name):
    df = _catalog(spark, name)
    assert _plan(df).count("regexp_extract_all") == 1
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_recaps_fit_compiled_code_and_fill_one_template(spark):
    df = _catalog(spark, "intent_recap")
    assert _plan(df).count("intent:long:km") == 5  # once for each template that names the unit
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert all("\n- " in r["text"] for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize("name", ["gen_train_set", "peek_messages"])
def test_turns_are_written_once(spark, name):
    assert _plan(_catalog(spark, name)).count("caps:system:gate") == 1


def test_vincenty_settles_within_its_rounds_or_not_at_all(spark):
    at = spark.range(400).selectExpr("0.1D + (id % 20) * 0.1 AS a", "178.5D + floor(id / 20) * 0.07 AS b")
    got = at.select(geodesy.vincenty(F.lit(0.0), F.lit(0.0), F.col("a"), F.col("b")).alias("v")).select("v.*").collect()
    assert {r["iterations"] for r in got if not r["converged"]} == {geodesy.MAX_ROUNDS} and any(8 < r["iterations"] < 200 for r in got)


@pytest.mark.parametrize("name", ["bucket_points", "summary", "bucket_counts", "choose_candidate", "feature_scores", "decision_trace", "score_join", "bucket_rates"])
def test_answers_are_split_once_by_many_tasks(spark, name):
    plan = _plan(_catalog(spark, name))
    assert plan.count(r"<\s*final\s*>") == 1 and plan.count(r"analysis\b") == 1
    assert plan.count("RepartitionByExpression") == 2  # the same for both sides of the join


@pytest.mark.parametrize(("text", "final", "analysis"), [("<final></final> analysis: a final: 3 km", "3 km", "a"), ("<analysis>x</analysis>analysis y", ">x</analysis>analysis y", "x"), ("<final> 1 </final><final>2</final>", "1", None), ("", "", None), (None, None, None)])
def test_odd_channels(spark, text, final, analysis):
    got = one(spark, channels.split_channels_tags(F.lit(text).cast("string")))
    assert (got["final"], got["analysis"]) == (final, analysis)
