"""Command line: gen-eval, gen-train, score."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators import generate, score
from .sources import io, schemas


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loxodrome")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("gen-eval", help="write an evaluation set")
    t = sub.add_parser("gen-train", help="write a training set")
    for s, n in ((g, 1000), (t, 10)):
        s.add_argument("--n", type=int, default=n)
        s.add_argument("--out", required=True)
        s.add_argument("--seed", type=int, default=0)
        s.add_argument("--phrases-dir")
        s.add_argument("--no-preview", action="store_true")
    t.add_argument("--json-only", action="store_true", help="print one example and write nothing")
    t.add_argument("--analysis-ratio", type=float, default=generate.P_ANALYSIS)
    t.add_argument("--distance-model", choices=("mixed", "wgs84", "sphere"), default="mixed")
    s = sub.add_parser("score", help="score stored model outputs")
    for name in ("--eval-file", "--outputs", "--out", "--summary"):
        s.add_argument(name, required=True)
    s.add_argument("--model", default="")
    s.add_argument("--variant", choices=sorted(score.VARIANTS), default="tag")
    s.add_argument("--limit", type=int)
    s.add_argument("--no-truth-boost", action="store_true")
    s.add_argument("--log")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loxodrome").getOrCreate()
    if args.command == "score":
        began, log = time.time(), io.logger(args.log)
        evals = io.read_eval_set(spark, args.eval_file, args.limit)
        outputs = io.read_outputs(spark, args.outputs)
        if args.limit is None and (lost := score.unmatched(evals, outputs).limit(1).count()):
            raise ValueError(f"{args.outputs} has outputs whose idx is not in {args.eval_file} ({lost} or more)")
        results = score.score(evals, outputs, score.VARIANTS[args.variant], not args.no_truth_boost)
        io.write_table(results, args.out, schemas.RESULTS)
        own = score.summary(spark.read.parquet(args.out), rates=args.variant == "channel")
        target = io.write_summary(own, args.summary, clobber=args.variant == "tag", model=args.model, eval_file=args.eval_file, results_file=args.out, **io.run_metadata(variant=args.variant), run_duration_sec=round(time.time() - began, 3))
        log.info("summary in %s", target)
        return 0
    from .functions.phrases import bank_from

    bank = bank_from(args.phrases_dir)
    if args.command == "gen-eval":
        df, schema = generate.eval_set(spark, args.n, args.seed, bank), "idx bigint, " + schemas.EVAL
    else:
        df, schema = generate.train_set(spark, args.n, args.seed, args.analysis_ratio, args.distance_model, bank), schemas.TRAIN
        if args.json_only:
            print(*df.limit(1).toJSON().collect())
            return 0
    io.write_table(df, args.out, schema)
    if not args.no_preview:
        print(*io.preview(spark.read.parquet(args.out)), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
