"""Site-level resampling of skill: pooled metrics with repeats, medians over distinct sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions.basics import settle
from freshet.operators import metrics as M
from freshet.operators.blocks import average_rank, quantiles
from freshet.operators.sampling import HELD, bootstrap_rows, number_entities, resampled_medians


def site_sums(df: DataFrame, site: str, y: str, p: str) -> DataFrame:
    """One row per site: everything a pooled metric needs, plus the site's own R2, mean APE and rank correlation."""
    a, b = F.col(y), F.col(p)
    pos = (a > 0) & (b > 0)
    la, lb = F.when(pos, F.ln(a)), F.when(pos, F.ln(b))
    g = df.groupBy(site).agg(
        *M.base_sums(y, p), F.count("*").alias("c"), F.sum(a).alias("sy"), F.sum(b).alias("sp"), F.sum(a * a).alias("syy"),
        F.sum(b * b).alias("spp"), F.sum(a * b).alias("syp"), F.count(la).alias("lc"), F.sum(la).alias("l1"), F.sum(la * la).alias("l2"),
        F.sum((la - lb) * (la - lb)).alias("lse"),
    )
    ape = F.when(a > 0, F.abs(a - b) / F.nullif(a, F.lit(0.0)) * 100)
    own = df.groupBy(site).agg(F.avg(ape).alias("mape"))
    g = g.withColumn("r2", M._report()["nse"]).select(site, "r2", "c", "sy", "sp", "syy", "spp", "syp", "lc", "l1", "l2", "lse")
    both = df.where(a.isNotNull() & b.isNotNull()).select(site, a.alias("_ya"), b.alias("_pb"))
    rho = average_rank(both, [site], {"_ra": "_ya", "_rb": "_pb"}).groupBy(site).agg(F.corr("_ra", "_rb").alias("rho"))
    return g.join(own, site, "left").join(rho, site, "left")


def site_bootstrap(df: DataFrame, site: str, y: str, p: str, seed: int, reps: int, hi: float = 0.5) -> DataFrame:
    """One row per replicate. Only per-site sums are resampled, never readings."""
    s = settle(site_sums(df, site, y, p))
    d = bootstrap_rows(s, site, seed, reps, counted=True)
    pool = lambda x: F.sum(F.col("m") * F.col(x))
    g = d.groupBy("rep").agg(
        *[pool(x).alias(x) for x in ("c", "sy", "sp", "syy", "spp", "syp", "lc", "l1", "l2", "lse")],
        (F.sum(F.col("r2") * F.col("c")) / F.sum(F.when(F.col("r2").isNotNull(), F.col("c")))).alias("mean_r2"),
        F.avg((F.col("r2") > 0).cast("double")).alias("frac_gt0"), F.avg((F.col("r2") > hi).cast("double")).alias("frac_hi"),
    )
    sst, spp = F.col("syy") - F.col("sy") * F.col("sy") / F.col("c"), F.col("spp") - F.col("sp") * F.col("sp") / F.col("c")
    cov = F.col("syp") - F.col("sy") * F.col("sp") / F.col("c")
    rho, alpha, beta = cov / F.sqrt(sst * spp), F.sqrt(spp / sst), F.col("sp") / F.col("sy")
    g = g.select(
        "rep", "mean_r2", "frac_gt0", "frac_hi",
        (1 - (F.col("syy") - 2 * F.col("syp") + F.col("spp")) / sst).alias("nse"),
        (1 - F.col("lse") / (F.col("l2") - F.col("l1") * F.col("l1") / F.col("lc"))).alias("log_nse"),
        (1 - F.sqrt((rho - 1) * (rho - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))).alias("kge"),
    )
    return g.join(quantiles(d, ["rep"], {"med_r2": ("r2", 0.5), "med_mape": ("mape", 0.5), "med_rho": ("rho", 0.5)}, few=True), "rep")


def median_by_group(values: DataFrame, site: str, by: list[str], col: str, seed: int, reps: int) -> DataFrame:
    """Interval of the per-group median over the distinct sites of each replicate."""
    v = settle(values.where(F.col(col).isNotNull()))
    num = settle(number_entities(v.select(site).distinct(), site, seed))
    most = num.count()
    if most <= HELD:
        own = v.join(num, site).dropna(subset=by)  # rows without a key are in no group
        m = resampled_medians(own, by, "idx", "n_all", col, seed, reps, most, once=True).withColumnRenamed("_x", "_m")
    else:
        m = quantiles(bootstrap_rows(v, site, seed, reps, counted=True), ["rep", *by], {"_m": (col, 0.5)}, few=True)
    return m.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"))
