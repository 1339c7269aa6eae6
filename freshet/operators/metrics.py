"""Skill metrics. One set of mergeable sums feeds every metric of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.basics import by_keys, c, clip, ratio, spread_join
from freshet.operators import blocks
from freshet.operators.blocks import average_rank, quantiles

TINY = 1e-10


def _floor(x: Column) -> Column:
    return F.greatest(x, F.lit(TINY))


def base_sums(y: str | Column, p: str | Column, prefix: str = "_") -> list[Column]:
    y, p = c(y), c(p)
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    a = {
        "n": F.count(y), "my": F.avg(y), "mp": F.avg(p), "sy": F.sum(y), "sp": F.sum(p),
        "vy": F.var_pop(y), "vp": F.var_pop(p), "cov": F.covar_pop(y, p), "sse": F.sum((y - p) * (y - p)),
    }
    return [e.alias(prefix + k) for k, e in a.items()]


def log_sums(y: str | Column, p: str | Column, shift: float = 0.0, prefix: str = "_l") -> list[Column]:
    """Sums of ln(x) on pairs that are both positive (shift 0) or of ln(1 + clipped x)."""
    y, p = c(y), c(p)
    if shift:
        ly, lp = F.log1p(clip(y, 0.0)), F.log1p(clip(p, 0.0))
    else:
        pos = (y > 0) & (p > 0)
        ly, lp = F.when(pos, F.ln(y)), F.when(pos, F.ln(p))
    return [
        F.count(ly).alias(prefix + "n"), F.var_pop(ly).alias(prefix + "v"), F.sum((ly - lp) * (ly - lp)).alias(prefix + "sse"),
    ]


def _c(name: str, prefix: str = "_") -> Column:
    return F.col(prefix + name)


def r2() -> Column:
    return 1 - _c("sse") / _floor(_c("vy") * _c("n"))


def report_from(prefix: str) -> dict[str, Column]:
    """R2, RMSE and slope from sums taken under another column prefix."""
    c_ = lambda n: _c(n, prefix)
    return {
        "r2": 1 - c_("sse") / _floor(c_("vy") * c_("n")),
        "rmse": F.sqrt(c_("sse") / F.nullif(c_("n"), F.lit(0))),
        "slope": F.when(c_("vy") > 0, c_("cov") / F.nullif(c_("vy"), F.lit(0.0))),
    }


def kge_parts() -> tuple[Column, Column, Column]:
    r = _c("cov") / F.nullif(F.sqrt(_c("vy")) * F.sqrt(_c("vp")), F.lit(0.0))
    return r, F.sqrt(_c("vp")) / _floor(F.sqrt(_c("vy"))), _c("mp") / _floor(_c("my"))


def kge() -> Column:
    r, a, b = kge_parts()
    return 1 - F.sqrt((r - 1) * (r - 1) + (a - 1) * (a - 1) + (b - 1) * (b - 1))


def _report() -> dict[str, Column]:
    two = _c("n") >= 2
    flat = (F.sqrt(_c("vp")) < TINY) | (F.sqrt(_c("vy")) < TINY)
    return {
        "n": _c("n"),
        "r2": r2(),
        "nse": F.when(two & (_c("vy") * _c("n") >= TINY), r2()),
        "rmse": F.sqrt(_c("sse") / F.nullif(_c("n"), F.lit(0))),
        "kge": kge(),
        "kge_guarded": F.when(two & ~flat, kge()),
        "kge_r": kge_parts()[0],
        "kge_alpha": kge_parts()[1],
        "kge_beta": kge_parts()[2],
        "pbias": 100 * (_c("sp") - _c("sy")) / _floor(_c("sy")),
        "bias_pct": F.when(_c("my") > 0, (_c("mp") - _c("my")) / F.nullif(_c("my"), F.lit(0.0)) * 100),
        "mean_bias": _c("mp") - _c("my"),
        "mean_true": _c("my"),
        "mean_pred": _c("mp"),
        "total_ratio": _c("sp") / _floor(_c("sy")),
        "slope": F.when(_c("vy") > 0, _c("cov") / F.nullif(_c("vy"), F.lit(0.0))),
        "log_nse": F.when((_c("ln") >= 2) & (_c("lv") * _c("ln") > TINY), 1 - _c("lsse") / F.nullif(_c("lv") * _c("ln"), F.lit(0.0))),
        "frac_within_2x": _c("w2"),
    }


def site_skill(df: DataFrame, by: list[str], y: str, p: str, names: list[str]) -> DataFrame:
    """The named metrics per group in one shuffle."""
    aggs = base_sums(y, p)
    if "log_nse" in names:
        aggs += log_sums(y, p)
    if "frac_within_2x" in names:
        q = F.when(c(y) > 0, c(p) / F.nullif(c(y), F.lit(0.0)))
        aggs.append(F.avg(q.between(0.5, 2.0).cast("double")).alias("_w2"))
    g = df.groupBy(*by).agg(*aggs)
    rep = _report()
    return g.select(*by, *[rep[n].alias(n) for n in names])


def spearman(df: DataFrame, by: list[str], y: str, p: str, out: str = "spearman_rho", middle: dict[str, Column] | None = None) -> DataFrame:
    """Correlation of average ranks, NULL without spread and for rows without a key.

    ``middle`` adds medians of expressions in ``y`` and ``p``, from the same exchange.

    Groups of up to ``blocks.TARGET`` rows are ranked where they lie, in one exchange for both columns; only larger ones (the list
    of them has at most one for each ``TARGET`` rows) are counted by value and cut into slices.
    """
    middle = middle or {}
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*by, F.col(y).alias("_y"), F.col(p).alias("_p"), *[e.alias(k) for k, e in middle.items()])

    def correlated(ranked: DataFrame, whole: bool = False) -> DataFrame:
        g = ranked.groupBy(*by).agg(
            F.covar_pop("_ry", "_rp").alias("_cv"), (F.stddev_pop("_ry") * F.stddev_pop("_rp")).alias("_sd"), F.count("*").alias("_n"),
            *[F.percentile(k, F.lit(0.5)).alias(k) for k in middle if whole],
        )
        return g.select(*by, F.when(F.col("_n") >= 2, ratio("_cv", "_sd")).alias(out), *[k for k in middle if whole])

    def sliced(rows: DataFrame) -> DataFrame:
        g = correlated(average_rank(rows.drop(*middle), by, {"_ry": "_y", "_rp": "_p"}))
        return by_keys(g, quantiles(rows, by, {k: (k, 0.5) for k in middle}), by, "left") if middle else g

    if not by:
        return sliced(d)
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])
    rows = d.where(keyed)
    big = F.broadcast(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > blocks.TARGET).select(*by))
    rank = lambda x: (F.rank().over(W.partitionBy(*by).orderBy(x)) + F.count("*").over(W.partitionBy(*by).orderBy(x))) / F.lit(2.0)
    calm = rows.join(big, by, "left_anti").withColumn("_ry", rank("_y")).withColumn("_rp", rank("_p"))
    full = sliced(rows.join(big, by, "left_semi"))
    none = d.where(~keyed).select(*by).distinct().withColumns({k: F.lit(None).cast("double") for k in (out, *middle)})
    return correlated(calm, True).unionByName(full).unionByName(none)


def full_report(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Everything the per-site table holds: sums, two medians and the rank correlation."""
    names = ["n", "nse", "log_nse", "kge_guarded", "rmse", "frac_within_2x", "bias_pct"]
    a = site_skill(df, by, y, p, names).withColumnRenamed("kge_guarded", "kge")
    err = F.abs(F.col(y) - F.col(p))
    m = quantiles(
        df.select(*by, F.when(F.col(y) > 0, err / F.nullif(F.col(y), F.lit(0.0)) * 100).alias("_ape"), err.alias("_ae")),
        by, {"mape_pct": ("_ape", 0.5), "median_abs_error": ("_ae", 0.5)},
    )
    s = spearman(df, by, y, p)
    return reduce(lambda x, z: by_keys(x, z, by, "left"), [m, s], a)


def guarded_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate, NULL without spread."""
    both = c(x).isNotNull() & c(y).isNotNull()
    x, y = F.when(both, c(x)), F.when(both, c(y))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def flow_strata(df: DataFrame, site: str, y: str, p: str, flow: str, qs: tuple[float, float] = (0.5, 0.9)) -> DataFrame:
    """Rows labelled by their site's own flow quantiles."""
    d = df.where(F.col(flow).isNotNull())
    th = quantiles(d, [site], {"_lo": (flow, qs[0]), "_hi": (flow, qs[1])})
    lo, hi = int(qs[0] * 100), int(qs[1] * 100)
    lab = F.when(F.col(flow) < F.col("_lo"), f"Q<{lo}").when(F.col(flow) < F.col("_hi"), f"Q{lo}-{hi}").otherwise(f"Q>{hi}")
    return spread_join(d, th, [site]).withColumn("stratum", lab).drop("_lo", "_hi")


def histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts between each group's own extremes."""
    lim = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = spread_join(df, lim, by) if by else by_keys(df, lim, by)
    pos = F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    return (
        d.withColumn("bin", F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int"))
        .groupBy(*by, "bin").agg(F.count("*").alias("n"))
    )
