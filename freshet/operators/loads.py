"""Sediment loads: rates, sums over days, months and water years, rating curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.basics import by_keys, c, clip, spread_join, stored
from freshet.operators import metrics as M

# fixed value: (mg/L) x (cubic feet per second) to short tons per day
LOAD_FACTOR = 0.0027


def rate(conc: str | Column, flow: str | Column) -> Column:
    return c(conc) * c(flow) * F.lit(LOAD_FACTOR)


def daily(df: DataFrame, site: str, t: str, load: str, min_readings: int = 77) -> DataFrame:
    g = df.groupBy(site, F.to_date(t).alias("day")).agg(F.avg(load).alias("_m"), F.count(load).alias("n"))
    return g.select(site, "day", "n", F.when(F.col("n") >= min_readings, F.col("_m")).alias(load))


def monthly(df: DataFrame, by: list[str], day: str, cols: list[str], share: float = 0.8) -> DataFrame:
    """Month sums, NULL when too few of the month's days have a value."""
    g = df.groupBy(*by, F.trunc(day, "month").alias("month")).agg(
        *[F.sum(x).alias(x) for x in cols], *[F.count(x).alias(f"n_{x}") for x in cols]
    )
    need = F.day(F.last_day("month")) * F.lit(share)
    return g.select(*by, "month", *[F.when(F.col(f"n_{x}") >= need, F.col(x)).alias(x) for x in cols], *[f"n_{x}" for x in cols])


def water_year(day: str | Column) -> Column:
    return F.year(c(day)) + (F.month(c(day)) >= 10).cast("int")


def yearly(df: DataFrame, by: list[str], day: str, cols: list[str], min_days: int = 292) -> DataFrame:
    g = df.groupBy(*by, water_year(day).alias("wy")).agg(
        *[F.sum(x).alias(x) for x in cols], *[F.count(x).alias(f"n_{x}") for x in cols]
    )
    return g.select(*by, "wy", *[F.when(F.col(f"n_{x}") >= min_days, F.col(x)).alias(x) for x in cols], *[f"n_{x}" for x in cols])


def rating_curve(cal: DataFrame, site: str, conc: str, flow: str) -> DataFrame:
    """Per-site log10-log10 fit with clipped smearing; sites with under three pairs are absent."""
    d = cal.where((F.col(conc) > 0) & (F.col(flow) > 0)).select(site, F.log10(conc).alias("_y"), F.log10(flow).alias("_x"))
    fit = d.groupBy(site).agg(
        F.count("*").alias("n_cal"), F.covar_pop("_x", "_y").alias("_c"), F.var_pop("_x").alias("_v"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my")
    ).where("n_cal >= 3")
    fit = fit.withColumn("slope", F.col("_c") / F.nullif(F.col("_v"), F.lit(0.0))).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    fit = fit.select(site, "n_cal", "slope", "intercept")
    res = spread_join(d, fit, [site]).groupBy(site).agg(F.avg(F.pow(F.lit(10.0), F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x"))).alias("_b"))
    return fit.join(res, site).withColumn("smear", clip("_b", 0.5, 5.0)).drop("_b")


def rated(flow: str) -> Column:
    """Concentration from the curve columns slope, intercept and smear."""
    x = F.log10(clip(flow, 0.01))
    return clip(F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * x) * F.col("smear"), 0, 1e6)


def load_metrics(df: DataFrame, by: list[str], ref: str, pred: str, min_rows: int = 5) -> DataFrame:
    """Skill of predicted against reference loads on rows where both exist."""
    d = stored(df.where(F.col(ref).isNotNull() & F.col(pred).isNotNull()).select(*by, ref, pred))  # sums, medians and ranks each read it
    names = ["n", "r2", "kge", "pbias", "total_ratio", "rmse"]
    g = d.groupBy(*by).agg(*M.base_sums(ref, pred), *M.log_sums(ref, pred, shift=1.0))
    rep = M._report()
    log_nse = 1 - F.col("_lsse") / F.greatest(F.col("_lv") * F.col("_ln"), F.lit(1e-10))
    g = g.select(*by, *[rep[x].alias(x) for x in names], log_nse.alias("log_nse")).where(F.col("n") >= min_rows)
    err = F.abs(F.col(pred) - F.col(ref)) / F.greatest(F.col(ref), F.lit(1e-3)) * 100
    sp = M.spearman(d, by, ref, pred, "spearman", {"median_error_pct": err})
    return by_keys(g, sp.select(*by, "median_error_pct", "spearman"), by, "left")


def timescales(df: DataFrame, site: str, t: str, obs: str, pred: str) -> DataFrame:
    """Total predicted over observed load at day, month and year grain, positive sums only."""
    d = F.to_date(t)
    grains = F.array(
        F.struct(F.lit("day").alias("grain"), d.alias("start")),
        F.struct(F.lit("month").alias("grain"), F.trunc(d, "month").alias("start")),
        F.struct(F.lit("year").alias("grain"), F.trunc(d, "year").alias("start")),
    )
    g = df.select(site, obs, pred, F.inline(grains)).groupBy(site, "grain", "start").agg(F.sum(obs).alias("o"), F.sum(pred).alias("p"))
    g = g.where("o > 0 and p > 0").groupBy("grain").agg(F.count("*").alias("n"), F.sum("o").alias("total_obs"), F.sum("p").alias("total_pred"))
    return g.withColumn("ratio", F.col("total_pred") / F.col("total_obs"))


def compare(daily_loads: DataFrame, site: str, day: str, ref: str, methods: list[str], month_share: float = 0.8, year_days: int = 292) -> DataFrame:
    """Report per site, scale (daily, transport, monthly, annual) and method."""
    cols = [ref, *methods]
    # rows of a site and year lie together, so every sum that follows is nearly done before it is shuffled
    daily_loads = stored(daily_loads.select(site, day, *cols).repartition(site, F.year(day)))
    d = daily_loads.select(site, *cols)
    scales = {
        "daily": d, "transport": d.where(F.col(ref) >= 1.0),
        "monthly": monthly(daily_loads, [site], day, cols, month_share).select(site, *cols),
        "annual": yearly(daily_loads, [site], day, cols, year_days).select(site, *cols),
    }
    u = reduce(lambda a, b: a.unionByName(b), [x.withColumn("scale", F.lit(n)) for n, x in scales.items()])
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in methods])
    long = u.select(site, "scale", F.col(ref).alias("ref"), F.inline(pairs))
    return load_metrics(long, [site, "scale", "method"], "ref", "pred")
