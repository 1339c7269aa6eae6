"""Duplicates, unions and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from freshet.operators.blocks import keep_first


def resolve_conflicts(
    df: DataFrame, keys: list[str], value: str, org: str, pos: str, agency: str = "usgs"
) -> DataFrame:
    """One row per key: values agree or are missing - first non-missing; else agency first.

    Only mergeable aggregates, so a key that holds a large share of the table is
    reduced on the map side.
    """
    row = F.struct(F.col(pos).alias("_p"), *[x for x in df.columns if x not in keys])
    has = F.col(value).isNotNull()
    ours = has & F.coalesce(F.lower(F.col(org)).contains(agency), F.lit(False))
    g = df.groupBy(*keys).agg(
        F.min(row).alias("_any"),
        F.min(F.when(has, row)).alias("_val"),
        F.min(F.when(ours, row)).alias("_own"),
        (F.min(value) < F.max(value)).alias("_conflict"),
        F.count("*").alias("n_copies"),
    )
    pick = F.when(F.col("_conflict") & F.col("_own").isNotNull(), F.col("_own")).otherwise(F.coalesce("_val", "_any"))
    return g.withColumn("_m", pick).select(
        *[F.col(x) if x in keys else F.col("_m")[x].alias(x) for x in df.columns],
        "n_copies",
        F.coalesce("_conflict", F.lit(False)).alias("was_conflict"),
    )


def stack(frames: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """Union by name with a provenance column; absent columns become NULL."""
    parts = [d.withColumn(source, F.lit(n)) for n, d in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stack_common(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union on shared columns, then the first row per key (left input first)."""
    shared = [x for x in a.columns if x in b.columns]
    u = a.select(*shared, F.lit(0).alias("_src")).unionByName(b.select(*shared, F.lit(1).alias("_src")))
    return keep_first(u, keys, ["_src", *order]).drop("_src")


def lost_gained(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    a = before.groupBy(key).agg(F.count("*").alias("n_before"))
    b = after.groupBy(key).agg(F.count("*").alias("n_after"))
    return a.join(b, key, "full").select(
        key,
        F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"),
        F.when(F.col("n_after").isNull(), "lost").when(F.col("n_before").isNull(), "gained").otherwise("kept").alias("state"),
    )
