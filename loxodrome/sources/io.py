"""Reading and writing the engine's tables and summaries."""

from __future__ import annotations

import itertools
import json
import logging
import subprocess
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.messages import peek
from . import schemas


def read_eval_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """An evaluation set with `idx`, the row's place: the column of that name, else numbers from 0 without gaps, by the files' names and the rows in them."""
    df = spark.read.parquet(path)
    if "idx" not in df.columns:
        place = F.col("_metadata.row_index")
        files = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("n")).orderBy("_file").collect()
        before = [0, *itertools.accumulate(f["n"] for f in files)][: len(files)]
        offsets = spark.createDataFrame([(f["_file"], b) for f, b in zip(files, before, strict=True)], "_file string, _before bigint")
        df = df.select("*", F.col("_metadata.file_path").alias("_file"), place.alias("_place")).join(F.broadcast(offsets), "_file")
        df = df.withColumn("idx", F.col("_before") + F.col("_place")).drop("_file", "_place", "_before")
    return df if limit is None else df.orderBy("idx").limit(limit)


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OUTPUTS).parquet(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """A training set; ValueError without its messages."""
    df = spark.read.parquet(path)
    if "messages" not in df.columns:
        raise ValueError(f"{path} has no column messages")
    return df


def write_table(df: DataFrame, path: str, schema: str | None = None, mode: str = "overwrite") -> None:
    """zstd Parquet; with a schema, exactly its columns and types (null where `df` has no such column)."""
    if schema:
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_summary(row: DataFrame, path: str, clobber: bool = True, **meta) -> Path:
    """A one-row summary as JSON; without clobber, an existing file stays and the new one gets the time in its name."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.exists() and not clobber:
        target = target.with_name(f"{target.stem}-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}{target.suffix}")
    target.write_text(json.dumps(meta | row.first().asDict(recursive=True), indent=2, ensure_ascii=False), encoding="utf-8")
    return target


def run_metadata(**config) -> dict:
    """Settings of a run, when it began, and the commit, if there is one."""
    said = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True)
    return {"config": config, "started": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "commit": said.stdout.strip() or None}


def logger(path: str | None = None) -> logging.Logger:
    """A log to standard output and, with a path, to a file as well."""
    log = logging.getLogger("loxodrome")
    log.setLevel(logging.INFO)
    for h in list(log.handlers):
        log.removeHandler(h)
    log.addHandler(logging.StreamHandler())
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        log.addHandler(logging.FileHandler(path, encoding="utf-8"))
    return log


def preview(df: DataFrame, rows: int = 3) -> list[str]:
    """First rows as JSON lines; of training sets the first messages, cut short."""
    if "messages" in df.columns:
        return [line for r in df.select(peek(F.col("messages")).alias("m")).limit(rows).collect() for line in r["m"]]
    return [r["j"] for r in df.limit(rows).select(F.to_json(F.struct("*")).alias("j")).collect()]
