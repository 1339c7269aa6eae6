"""Random effects and adaptation curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from freshet.functions.basics import dealt, settle, stored, with_scalar
from freshet.operators import sampling as S
from freshet.operators.blocks import medians, quantiles


def variance_components(df: DataFrame, site: str, resid: str) -> DataFrame:
    """One row: within-site variance and between-site intercept variance by moments."""
    per = df.groupBy(site).agg(F.count(resid).alias("n"), F.avg(resid).alias("m"), F.var_pop(resid).alias("v"))
    return per.agg(
        F.greatest(F.sum(F.when(F.col("n") > 1, F.col("v") * F.col("n")).otherwise(0.0)) / F.greatest(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)), F.lit(1)), F.lit(1e-6)).alias("sigma2"),
        F.var_pop("m").alias("_vm"), F.avg(1.0 / F.greatest("n", F.lit(1))).alias("_inv"),
    ).select("sigma2", F.greatest(F.col("_vm") - F.col("sigma2") * F.col("_inv"), F.lit(1e-6)).alias("between"))


def random_intercepts(train: DataFrame, target: DataFrame, site: str, resid: str) -> DataFrame:
    """Shrunk site intercepts of ``target`` rows under the variances of ``train``.

    With target = train these are the fitted effects; with new sites, their estimates
    from calibration rows.
    """
    per = target.groupBy(site).agg(F.count(resid).alias("n"), F.avg(resid).alias("mean_resid"))
    d = with_scalar(per, variance_components(train, site, resid))
    shrink = F.col("between") / (F.col("between") + F.col("sigma2") / F.col("n"))
    return d.withColumn("shrinkage", shrink).withColumn("intercept", F.col("shrinkage") * F.col("mean_resid"))


def curve(per_site: DataFrame, site: str, cols: list[str], by: list[str], boot_col: str = "nse", seed: int = 42, reps: int = 1000) -> DataFrame:
    """Median over sites per (mode, n) and a resampling interval of the first metric."""
    m = medians(per_site, by, **{f"median_{x}": x for x in cols})
    n = per_site.groupBy(*by).agg(F.count("*").alias("n_sites"))
    v = per_site.where(F.col(boot_col).isNotNull()).select(site, *by, boot_col)
    num = settle(S.number_in(v, by, [F.lit(str(seed)), site], site))
    rows, most = num.agg(F.count(F.lit(1)), F.max("_m")).first()
    if (most or 0) <= S.HELD:
        meds = S.resampled_medians(num, by, "_rn", "_m", boot_col, seed, reps, most or 0)
    else:
        rows *= reps
        slots = dealt(num.select(*by, "_m", "_rn"), rows=rows).select(*by, "_m", "_rn", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
        pick = S.draw(F.lit(str(seed)), "rep", "_rn") % F.col("_m") + 1
        # the numbered values are the small side, whatever the estimates say
        got = dealt(slots.select(*by, "rep", pick.alias("_rn")), *by, "_rn", rows=rows).join(num.select(*by, "_rn", boot_col).hint("shuffle_hash"), [*by, "_rn"])
        meds = quantiles(got, [*by, "rep"], {"_x": (boot_col, 0.5)}, few=True)
    ci = meds.groupBy(*by).agg(F.percentile("_x", F.lit(0.025)).alias("ci_lo"), F.percentile("_x", F.lit(0.975)).alias("ci_hi"))
    return m.join(n, by).join(ci, by, "left")


def effort(scores: DataFrame, by: list[str], site: str, col: str) -> DataFrame:
    """Median and quartiles of all trial scores per calibration size; scores are made once for both passes over them."""
    scores = stored(scores.select(*by, site, col))
    q = quantiles(scores, by, {f"{col}_median": (col, 0.5), f"{col}_q25": (col, 0.25), f"{col}_q75": (col, 0.75)})
    return q.join(scores.groupBy(*by).agg(F.countDistinct(site).alias("n_sites")), by)


def monotone_breaks(curve_df: DataFrame, by: list[str], n: str, value: str, tol: float = 0.0) -> DataFrame:
    """Steps of a curve that fall by more than the tolerance (a curve has a few points)."""
    w = W.partitionBy(*by).orderBy(n)
    d = curve_df.withColumn("n_before", F.lag(n).over(w)).withColumn("decrease", F.lag(value).over(w) - F.col(value))
    return d.where(F.col("decrease") > tol).select(*by, "n_before", n, "decrease")
