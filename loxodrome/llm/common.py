"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one Python slice of an Arrow batch may hold (a single longer text is a slice of its own).
SLICE_CHARS = 6_000_000
#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
WORD_SPACE = " \t\n\v\f\r"
#: The same rule as a regular expression for the JVM.
WORD_SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8 bytes; a null text has none."""
    return text.encode().split() if text else []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only on a local master where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="loxodrome-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Settings of the queries that fill written tables: shuffle files go as soon as a query has ended, and batches for Python are bounded in bytes.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile have those settings; the session's own are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage and survives lost executors; the files go with the checkpoint folder, or earlier by discard(). The shuffle
    files that only the write needed are released when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def gathered(frames: Iterable[DataFrame]) -> DataFrame:
    """One written table of all frames, appended one after the other, so that only one frame's shuffle files are on disk at a time."""
    path, out = None, None
    for one in frames:
        path = path or f"{scratch_root(one.sparkSession)}/tables/{uuid.uuid4().hex}"
        with released(one.sparkSession):
            one.write.mode("append").option("compression", "zstd").parquet(path)
        out = one
    table = out.sparkSession.read.schema(out.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for one in tables:
        jvm = one.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(one.scratch_path)
        path.getFileSystem(one.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fan_out(df: DataFrame, parts: int | None = None) -> int:
    """Shuffle partitions of the session, the number of salts and buckets that scales with the cluster's settings."""
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str | None = "text", most: int = SLICE_CHARS) -> Iterator[dict[str, list]]:
    """Columns as Python lists, a bounded number of text characters at a time; whole batches where there is no text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if text is None:
            yield batch.to_pydict()
            continue
        start, room = 0, most
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        for i, n in enumerate(lengths):
            if room < (n or 0) and i > start:
                yield batch.slice(start, i - start).to_pydict()
                start, room = i, most
            room -= n or 0
        yield batch.slice(start).to_pydict()


def in_fold(column: str = "doc_id", folds: int = 5):
    """crc32 of the id as text (empty where there is none), modulo the number of folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds
