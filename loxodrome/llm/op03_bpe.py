"""BPE encoding and decoding by prefix-sharing trie traversal."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import encoder
from .common import slices, table

ORACLE_SQL = None
DEFAULT_FILE = "byte_bpe_50k.json"


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: `ids binary` (little-endian unsigned 32-bit), `n_tokens`, `decoded`.

    A null text is encoded as the empty text (no ids, decoded to ""). Repeated rows give repeated rows; other columns
    of `docs` are not read. Narrow: one pass, no shuffle, memory bounded by one slice of texts and the remembered pieces.
    """

    def run(batches):
        bpe = encoder(path)
        for part in slices(batches, text_col):
            ids = bpe.encode_batch(part[text_col])
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: pa.array(part[id_col], id_type),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                    "decoded": pa.array([bpe.decode(x) for x in ids], pa.string()),
                }
            )

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[docs.schema[id_col].dataType.simpleString()]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The round trip's digests; the ids and texts stay in the worker, so that none of them cross to the JVM."""

    def run(batches):
        bpe = encoder(path)
        for part in slices(batches, text_col):
            ids = bpe.encode_batch(part[text_col])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(part[id_col], pa.int64()),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                }
            )

    return docs.selectExpr(f"{id_col} AS {id_col}", text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(DEFAULT_FILE))
