"""Top lists: ordering with a limit, always with a tie-break key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def extremes(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    best = df.orderBy(F.desc(value), key).limit(n).withColumn("kind", F.lit("best"))
    worst = df.orderBy(value, key).limit(n).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst)


def rows_of_largest(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the n entities with most rows; the list has n entries, so it is broadcast."""
    top = df.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def winners(df: DataFrame, key: str, gain: str, margin: float, n: int) -> DataFrame:
    """Entities where one method wins beyond the margin, n per side."""
    lose = df.where(F.col(gain) < -margin).orderBy(gain, key).limit(n).withColumn("winner", F.lit("curve"))
    win = df.where(F.col(gain) > margin).orderBy(F.desc(gain), key).limit(n).withColumn("winner", F.lit("model"))
    return lose.unionByName(win)
