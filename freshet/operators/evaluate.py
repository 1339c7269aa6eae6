"""Evaluation tables built from the metric sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions import transforms as X
from freshet.functions.basics import clip, with_scalar
from freshet.operators import metrics as M
from freshet.operators.blocks import medians, quantiles


def native_metrics(df: DataFrame, by: list[str], y: str, p: str, kind: str, lam: float | None, factor: Column) -> DataFrame:
    """Metrics after back-transform; the factor corrects predictions only."""
    d = df.select(*by, clip(X.inverse(y, kind, lam), 0).alias("_y"), clip(X.inverse(p, kind, lam) * factor, 0).alias("_p"))
    m = M.site_skill(d, by, "_y", "_p", ["r2", "rmse", "pbias"])
    return m.withColumnsRenamed({x: f"{x}_native" for x in ("r2", "rmse", "pbias")})


def all_metrics(df: DataFrame, y: str, p: str, flow: str, lo: str, hi: str) -> DataFrame:
    q = quantiles(df, [], {"_q90": (flow, 0.9)})
    d = with_scalar(df, q)
    err = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    g = d.agg(
        *M.base_sums(y, p),
        F.sum(F.col(y) * F.col(flow)).alias("_ly"), F.sum(F.col(p) * F.col(flow)).alias("_lp"),
        F.avg(F.when(F.col(flow) >= F.col("_q90"), err)).alias("_st"),
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("picp"),
    )
    rep = M._report()
    return g.select(
        *[rep[n].alias(n) for n in ("n", "r2", "rmse", "kge", "kge_r", "kge_alpha", "kge_beta", "pbias")],
        (100 * (F.col("_lp") - F.col("_ly")) / F.greatest("_ly", F.lit(1e-10))).alias("load_bias"),
        F.sqrt("_st").alias("storm_rmse"), "picp",
    )


def baselines(df: DataFrame, site: str, y: str) -> DataFrame:
    """Rows scored by the global mean and by their site's mean."""
    site_mean = df.groupBy(site).agg(F.avg(y).alias("_s"))
    d = with_scalar(df.select(site, y), df.agg(F.avg(y).alias("_g"))).join(site_mean, site)
    pair = F.array(
        F.struct(F.lit("global_mean").alias("predictor"), F.col("_g").alias("p")),
        F.struct(F.lit("site_mean").alias("predictor"), F.col("_s").alias("p")),
    )
    return d.select(site, y, F.inline(pair))


def fold_summary(df: DataFrame, fold: str, site: str, y: str, p: str) -> DataFrame:
    """Medians over folds (their number is a parameter) and the median site R2."""
    m = df.groupBy(fold).agg(*M.base_sums(y, p), F.avg(F.exp(F.log1p(y) - F.log1p(p))).alias("factor"))
    rep = M._report()
    names = ["r2", "kge", "rmse", "pbias"]
    m = m.select(*[rep[n].alias(n) for n in names], "factor")
    g = m.agg(*[F.median(x).alias(x) for x in [*names, "factor"]], F.count("*").alias("n_folds"))
    s = M.site_skill(df, [site], y, p, ["nse"])
    return with_scalar(g, medians(s, [], median_site_r2="nse"))


def log_bins(df: DataFrame, x: str, bins: int, out: str = "bin", closed: bool = False) -> DataFrame:
    """Equal-width bins of log10(x) between the extremes; ``closed`` puts the maximum in the last bin."""
    lx = F.log10(x)
    d = with_scalar(df, df.agg(F.min(lx).alias("_lo"), F.max(lx).alias("_hi")))
    b = F.floor((lx - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    return d.withColumn(out, (F.least(b, F.lit(bins - 1)) if closed else b).cast("int")).drop("_lo", "_hi")


def target_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = df.select(F.col(target).alias("y"), F.inline(pairs))
    return long.groupBy("feature").agg(M.guarded_corr("x", "y").alias("corr"))
