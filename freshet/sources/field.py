"""Field (hand-held) readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def routine_readings(df: DataFrame, unit: str, activity: str) -> DataFrame:
    """Rows in the sensor's unit taken as routine samples."""
    return df.where((F.col(unit) == "FNU") & (F.col(activity) == "Sample-Routine"))
