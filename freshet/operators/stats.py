"""Rank tests. Statistics are exact; p-values use published approximations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from freshet.functions.basics import with_scalar
from freshet.functions.special import chi2_upper, normal_two_sided
from freshet.operators import metrics as M
from freshet.operators.blocks import average_rank, medians


def attribute_correlations(df: DataFrame, attrs: list[str], metric: str, min_n: int = 5) -> DataFrame:
    """Rank correlation of every attribute with a metric, strongest evidence first."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("_x")) for a in attrs])
    long = df.select(F.col(metric).alias("_y"), F.inline(pairs)).where("_x is not null and _y is not null")
    n = long.groupBy("attribute").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    rho = M.spearman(long, ["attribute"], "_x", "_y", "rho")
    d = n.join(rho, "attribute").withColumn("z", F.col("rho") * F.sqrt(F.col("n") - 1))
    return d.withColumn("p_value", normal_two_sided("z")).orderBy("p_value", "attribute")


def wilcoxon(a: DataFrame, b: DataFrame, key: str, metrics: list[str], min_n: int = 5) -> DataFrame:
    """Paired signed-rank test over shared entities, one row per metric."""
    one = a.select(key, *[F.col(m).alias(f"_a_{m}") for m in metrics]).join(b.select(key, *[F.col(m).alias(f"_b_{m}") for m in metrics]), key)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"_b_{m}") - F.col(f"_a_{m}")).alias("diff")) for m in metrics])
    d = one.select(F.inline(pairs)).where("diff is not null")
    shared = d.groupBy("metric").agg(F.count("*").alias("n_shared"), F.avg("diff").alias("mean_diff"))
    nz = average_rank(d.where("diff <> 0").withColumn("_m", F.abs("diff")), ["metric"], {"_r": "_m"})
    g = nz.groupBy("metric").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("diff") > 0, F.col("_r")).otherwise(0.0)).alias("_wp"),
        F.sum(F.when(F.col("diff") < 0, F.col("_r")).otherwise(0.0)).alias("_wm"),
    ).where(F.col("n") >= min_n)
    n = F.col("n").cast("double")
    g = g.withColumn("w", F.least("_wp", "_wm"))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    g = g.withColumn("z", (F.col("w") - n * (n + 1) / 4) / sd).withColumn("effect", F.abs("z") / F.sqrt(n))
    g = g.withColumn("p_value", normal_two_sided("z")).select("metric", "n", "w", "z", "effect", "p_value")
    return reduce(lambda x, y: x.join(y, "metric"), [shared, medians(d, ["metric"], median_diff="diff")], g)


def _frequent(df: DataFrame, cat: str, min_n: int) -> DataFrame:
    keep = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.count("*").alias("_k")).where(F.col("_k") >= min_n).select(cat)
    return df.join(keep, cat, "left_semi")


def kruskal(df: DataFrame, cat: str, value: str, min_n: int = 5) -> DataFrame:
    """H over categories with enough rows, corrected for ties."""
    d = average_rank(_frequent(df.where(F.col(value).isNotNull()), cat, min_n), [], {"_r": value}, ties="_t")
    per = d.groupBy(cat).agg(F.sum("_r").alias("_s"), F.count("*").alias("_n"), F.sum(F.col("_t").cast("double") * F.col("_t") - 1).alias("_tie"))
    g = per.agg(F.sum("_n").alias("n"), F.count("*").alias("k"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_q"), F.sum("_tie").alias("_tt"))
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    # every tied row carries t^2 - 1, so a group of t equal values adds t^3 - t
    g = g.withColumn("h", h / (1 - F.col("_tt") / (n * n * n - n))).select("n", "k", "h")
    return g.withColumn("p_value", chi2_upper("h", F.col("k") - 1))


def indicator_rho(df: DataFrame, cat: str, value: str, min_n: int = 5) -> DataFrame:
    """Rank correlation of each category's 0/1 indicator with the value.

    The ranks of an indicator are two numbers, so the correlation follows from the
    category's mean rank: no category-by-row table is built.
    """
    d = average_rank(df.where(F.col(value).isNotNull()), [], {"_r": value})
    tot = d.agg(F.count("*").alias("_N"), F.avg("_r").alias("_mr"), F.stddev_pop("_r").alias("_sr"))
    g = d.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.count("*").alias("n"), F.avg("_r").alias("_cr")).where(F.col("n") >= min_n)
    g = with_scalar(g, tot)
    p = F.col("n") / F.col("_N")
    rho = p * (F.col("_cr") - F.col("_mr")) / F.nullif(F.sqrt(p * (1 - p)) * F.col("_sr"), F.lit(0.0))
    g = g.withColumn("rho", rho).withColumn("p_value", normal_two_sided(rho * F.sqrt(F.col("_N") - 1))).select(cat, "n", "rho", "p_value")
    return g.join(medians(df, [cat], median=value), cat)


def group_stats(df: DataFrame, cat: str, value: str, min_n: int = 5) -> DataFrame:
    g = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return g.where(F.col("n") >= min_n).join(medians(df, [cat], median=value), cat)
