"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loxodrome.llm import op04_jaccard, op05_packing, op06_lines, op08_suffix, op09_toxicity
from loxodrome.llm.common import scratch_root, table

STAGES = [
    ("toxicity", op09_toxicity.stage),
    ("line_dedup", op06_lines.stage),
    ("ngram_jaccard_join", op04_jaccard.stage),
    ("suffix_array_dedup", op08_suffix.stage),
    ("packing", op05_packing.stage),
]

#: The conditional random field and the tokenizer can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; the result of the last is returned as it was written."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch_root(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
