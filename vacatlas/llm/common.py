"""Helpers the operators share: reading tables, batches bounded by bytes, stored tables, binary files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import work_path

#: Texts handled at once in a task, in bytes. A longer text is handled alone.
BATCH_BYTES = 8 << 20


def source(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A supplied table, read whole; only the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under names of its own; null texts are empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column that hold about ``limit`` bytes each, one row at least."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def bounded(batches, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The record batches, cut so that each holds about ``limit`` bytes of a column."""
    for batch in batches:
        for start, stop in slices(batch.column(column), limit):
            yield batch.slice(start, stop - start)


def record(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table below the shared folder, in folders of ``by``, and read it back: lineage ends, it is computed once."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_text(column: str | Column) -> Column:
    """crc32 of a value's text; null for null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


#: A skippable frame of one byte, left open: the line end that Spark's text writer puts behind a row closes it.
TAIL = (0x184D2A50).to_bytes(4, "little") + (1).to_bytes(4, "little")


def write_files(df: DataFrame, path: str, column: str = "file") -> None:
    """Write each row's bytes as a file of its own, through Spark's committed writer and so to any store it reaches.

    The writer ends each file with one newline. Formats here end with ``TAIL``, which makes the newline the body of
    a skippable frame.
    """
    df.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of each file in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
