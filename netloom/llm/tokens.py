"""Encoding of a whole table of texts with a public tokenizer (problem 6): one narrow Arrow pass, no shuffle."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .bpe import encoder

#: Vocabulary file of the queries; every function takes another one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def sent(spark: SparkSession, vocabulary: str) -> str:
    """Send the vocabulary file with the job, so that only the driver needs it; its name on the executors."""
    sc, name = spark.sparkContext, os.path.basename(vocabulary)
    if name not in {os.path.basename(f) for f in sc.listFiles}:
        sc.addFile(vocabulary)
    return name


def placed(name: str) -> str:
    """Where a task finds a file that was sent."""
    return SparkFiles.get(name)


def encode_texts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every whole text, without special tokens.

    Null and empty texts have an empty list; strings of special tokens in a text are ordinary text; rows with equal or
    null keys stay separate rows; an empty table gives no rows; extra columns are ignored. The vocabulary file is
    sent with the job.
    """
    name = sent(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(placed(name)).encode_bytes
        for b in batches:
            rows = [encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int64) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>")


def _p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p6_ids": _p6_ids}
ORACLES: dict[str, str] = {}
