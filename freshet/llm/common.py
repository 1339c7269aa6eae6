"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.basics import scratch, settle

__all__ = ["documents", "kept", "row_key", "settle", "signed", "batches"]

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """A written table in the shared folder: cuts the lineage of a result that several jobs read.

    ``options`` go to the Parquet writer. It goes when the application ends, as the DataFrame returned may be read until then.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, **options)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def signed(x: int) -> int:
    """A 64-bit pattern as Spark's long."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over every column: equal rows, and in practice only those, agree on both."""
    cols = [F.col(f"`{n}`") for n in df.columns]
    marks = [c.isNull() for c in cols]
    return [F.xxhash64(*cols, *marks), F.xxhash64(F.lit(1), *cols, *marks)]


def batches(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most ``most`` rows, so that what is built from one stays small."""
    for b in rows:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)
