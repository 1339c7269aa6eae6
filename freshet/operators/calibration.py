"""Field visits against the installed sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.operators.blocks import medians, modal

MIN_SENSOR = 5.0


def calibration_pairs(df: DataFrame, field: str, sensor: str) -> DataFrame:
    """Offset and ratio of pairs whose sensor value is above the noise floor."""
    return df.where(F.col(sensor) > MIN_SENSOR).select(
        "*", (F.col(field) - F.col(sensor)).alias("offset"), (F.col(field) / F.col(sensor)).alias("ratio")
    )


def calibration_summary(pairs: DataFrame, site: str, t: str, family: str) -> DataFrame:
    a = pairs.groupBy(site).agg(
        F.count("*").alias("n_visits"), F.stddev_samp("offset").alias("std_offset"),
        F.min(t).alias("first_visit"), F.max(t).alias("last_visit"),
    )
    return a.join(medians(pairs, [site], median_offset="offset"), site).join(modal(pairs, [site], family, "sensor_family"), site)
