"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python, and bytes of text worked on at once.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_ready(df: DataFrame) -> DataFrame:
    """Keeps the Arrow batches of Python stages small, as texts can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def raw_texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes of text, one row at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
