"""Resume-safe ingestion of chunk files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from freshet.operators.blocks import keep_first


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType, keys: list[str], order: list[str], max_files: int | None = None) -> None:
    """Process the chunk files not seen yet and stop.

    The checkpoint remembers finished files. A micro-batch writes its own folder and
    overwrites it on retry, so a lost executor or a restart cannot duplicate rows.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        keep_first(batch, keys, order).write.mode("overwrite").parquet(f"{sink}/batch={epoch:08d}")

    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    q = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingested(spark: SparkSession, sink: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table so far: one row per key, the earliest batch wins."""
    d = spark.read.option("basePath", sink).parquet(sink).withColumn("batch", F.col("batch").cast("long"))
    return keep_first(d, keys, ["batch", *order]).drop("batch")
