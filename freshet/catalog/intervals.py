"""Prediction intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.joins import rsel
from freshet.catalog.registry import query
from freshet.functions import transforms as X
from freshet.functions.basics import r, with_scalar
from freshet.operators import intervals as I
from freshet.operators.blocks import medians

BIN = """case when p >= 0 and p < 30 then '0-30' when p >= 30 and p < 100 then '30-100' when p >= 100 and p < 500 then '100-500'
      when p >= 500 and p < 2000 then '500-2000' when p >= 2000 then '2000+' end"""
MV = {"v_b": f"select oid, y, p, y - p as res, {BIN} as bin from v_pred",
      "v_bound": """select bin, quantile_cont(res, 0.05) as lo90, quantile_cont(res, 0.95) as hi90, quantile_cont(res, 0.1) as lo80, quantile_cont(res, 0.9) as hi80,
        quantile_cont(abs(res), 0.5) as mar, count(*) as n from v_b where bin is not null group by bin""",
      "v_app": "select oid, y, p, bin, greatest(p + lo90, 0) as lower, p + hi90 as upper from v_b left join v_bound using (bin)",
      "v_cov": "select *, y between lower and upper as covered, upper - lower as width from v_app"}


@query("pi_mondrian_fit", """select bin, R(lo90) as lo90, R(hi90) as hi90, R(lo80) as lo80, R(hi80) as hi80, R(mar) as median_abs_residual, n as n_calibration, n >= 50 as reliable from v_bound""", MV)
def _(t):
    return I.mondrian_fit(t.pred, "y", "p").select("bin", *rsel("lo90", "hi90", "lo80", "hi80", "median_abs_residual"), "n_calibration", "reliable")


@query("pi_mondrian_apply", "select oid, bin, R(lower) as lower, R(upper) as upper, covered, R(width) as width from v_cov", MV)
def _(t):
    d = I.mondrian_apply(t.pred, I.mondrian_fit(t.pred, "y", "p"), "y", "p")
    return d.select("oid", "bin", *rsel("lower", "upper"), "covered", *rsel("width"))


@query("pi_coverage", """select coalesce(bin, 'ALL') as bin, count(*) as n, R(avg(cast(covered as int))) as coverage, R(avg(width)) as mean_width, R(quantile_cont(width, 0.5)) as median_width
    from v_cov group by grouping sets ((), (bin))""", MV)
def _(t):
    d = I.mondrian_apply(t.pred, I.mondrian_fit(t.pred, "y", "p"), "y", "p")
    return I.coverage(d, "bin").select("bin", "n", *rsel("coverage", "mean_width", "median_width"))


LV = "[" + ", ".join(repr(0.01 + i * 0.98 / 19) for i in range(20)) + "]"
KV = {"v_k0": ("select unnest(range(0, 20)) as knot, unnest(quantile_cont(p, " + LV + ")) as x, unnest(quantile_cont(p, [" + ", ".join(
          repr(max(0.0, 0.01 + i * 0.98 / 19 - 0.075)) for i in range(20)) + "])) as a, unnest(quantile_cont(p, [" + ", ".join(
          repr(min(1.0, 0.01 + i * 0.98 / 19 + 0.075)) for i in range(20)) + "])) as b from v_pred"),
      "v_knot": """select cast(knot as int) as knot, x, count(*) as n_local, quantile_cont(y - p, 0.05) as lo90, quantile_cont(y - p, 0.95) as hi90, quantile_cont(y - p, 0.1) as lo80, quantile_cont(y - p, 0.9) as hi80
        from v_k0 join v_pred on p between a and b group by knot, x""",
      "v_seg": "select x, lo90, hi90, lead(x) over (order by x) as x2, lead(lo90) over (order by x) as lo2, lead(hi90) over (order by x) as hi2, row_number() over (order by x) as i from v_knot"}


@query("pi_knots", "select knot, n_local, R(x) as x, R(lo90) as lo90, R(hi90) as hi90, R(lo80) as lo80, R(hi80) as hi80 from v_knot", KV)
def _(t):
    return I.knots(t.pred, "y", "p").select("knot", "n_local", *rsel("x", "lo90", "hi90", "lo80", "hi80"))


@query("pi_interp", """with j as (select oid, y, p, case when i = 1 and p < x then lo90 when x2 is null then lo90 else lo90 + (lo2 - lo90) * (p - x) / (x2 - x) end as lo,
      case when i = 1 and p < x then hi90 when x2 is null then hi90 else hi90 + (hi2 - hi90) * (p - x) / (x2 - x) end as hi
      from v_pred join v_seg on (p >= x and (x2 is null or p < x2)) or (i = 1 and p < x))
    select oid, R(greatest(p + lo, 0)) as lower, R(p + hi) as upper, y between greatest(p + lo, 0) and p + hi as covered from j""", KV)
def _(t):
    d = I.continuous_bounds(t.pred, I.knots(t.pred, "y", "p"), "y", "p")
    return d.select("oid", *rsel("lower", "upper"), "covered")


SV = {"v_sq": "select quantile_cont(e, 0.025) as l95, quantile_cont(e, 0.975) as h95, quantile_cont(e, 0.05) as l90, quantile_cont(e, 0.95) as h90 from (select ln(1 + y) - ln(1 + p) as e from v_pred)",
      "v_sb": """select oid, method, y, greatest(exp(ln(1 + p) + l95) - 1, 0) as lower95, exp(ln(1 + p) + h95) - 1 as upper95, greatest(exp(ln(1 + p) + l90) - 1, 0) as lower90, exp(ln(1 + p) + h90) - 1 as upper90 from v_pred, v_sq"""}


@query("pi_split", "select oid, R(lower95, 3) as lower95, R(upper95, 3) as upper95, R(lower90, 3) as lower90, R(upper90, 3) as upper90 from v_sb", SV)
def _(t):
    d = I.split_bounds(t.pred, t.pred, "y", "p")
    return d.select("oid", *rsel("lower95", "upper95", "lower90", "upper90", d=3))


@query("pi_split_metrics", """select method, count(*) as n, R(avg(case when y between lower90 and upper90 then 1.0 else 0.0 end)) as coverage, R(avg(upper90 - lower90)) as mean_width,
    R(quantile_cont(upper90 - lower90, 0.5)) as median_width, R(quantile_cont((upper90 - lower90) / y, 0.5)) as median_ratio from v_sb group by method""", SV)
def _(t):
    d = I.interval_metrics(I.split_bounds(t.pred, t.pred, "y", "p"), ["method"], "y", "lower90", "upper90")
    return d.select("method", "n", *rsel("coverage", "mean_width", "median_width", "median_ratio"))


QV = {"v_q": """select oid, site, method, y, (pow(1 + y, 0.2) - 1) / 0.2 as t, (pow(1 + p, 0.2) - 1) / 0.2 - 0.3 - 0.02 * (oid % 7) as q05, (pow(1 + p, 0.2) - 1) / 0.2 - 0.2 - 0.03 * (oid % 5) as q10,
        (pow(1 + p, 0.2) - 1) / 0.2 + 0.25 + 0.02 * (oid % 3) as q90, (pow(1 + p, 0.2) - 1) / 0.2 + 0.2 + 0.05 * (oid % 4) as q95 from v_pred""",
      "v_sc": "select *, greatest(q05 - t, t - q95) as s from v_q",
      "v_hat": """select s0 + (s1 - s0) * (pos - floor(pos)) as q_hat from (select max(s) filter (i = floor(pos)) as s0, max(s) filter (i = ceil(pos)) as s1, any_value(pos) as pos from
        (select s, row_number() over (order by s) - 1 as i, least(ceil((count(*) over () + 1) * 0.9::double) / count(*) over (), 1.0) * (count(*) over () - 1) as pos from v_sc))""",
      "v_inv": """select oid, method, y, t, q05 - q_hat as lm, q95 + q_hat as um, least(greatest(pow(greatest((q05 - q_hat) * 0.2 + 1, 2e-11), 5) - 1, 0), 1e8) as lower,
        least(greatest(pow(greatest((q95 + q_hat) * 0.2 + 1, 2e-11), 5) - 1, 0), 1e8) as upper, q_hat from v_q, v_hat"""}


def quant(t):
    m, c = X.forward("p", "boxcox", 0.2), lambda k: F.col("oid") % k
    return t.pred.select("oid", "site", "method", "y", X.forward("y", "boxcox", 0.2).alias("t"), (m - 0.3 - c(7) * 0.02).alias("q05"),
                         (m - 0.2 - c(5) * 0.03).alias("q10"), (m + 0.25 + c(3) * 0.02).alias("q90"), (m + 0.2 + c(4) * 0.05).alias("q95"))


@query("pi_cqr_scores", "select oid, R(s) as score from v_sc", QV)
def _(t):
    return quant(t).select("oid", r(I.conformity("q05", "q95", "t")).alias("score"))


@query("pi_cqr_qhat", "select R(q_hat) as q_hat from v_hat", QV)
def _(t):
    return I.q_hat(quant(t).withColumn("s", I.conformity("q05", "q95", "t")), "s", 0.1).select(r("q_hat").alias("q_hat"))


@query("pi_cqr_apply", """select R(any_value(q_hat)) as q_hat, count(*) as n, R(avg(case when t between lm and um then 1.0 else 0.0 end), 3) as coverage_ms, R(avg(case when y between lower and upper then 1.0 else 0.0 end), 3) as coverage,
    R(quantile_cont(upper - lower, 0.5), 2) as median_width, R(avg(upper - lower), 2) as mean_width, R(quantile_cont((upper - lower) / greatest(y, 1e-6), 0.5), 3) as median_ratio,
    R(avg(case when upper - lower < 0.01 then 1.0 else 0.0 end)) as frac_zero from v_inv""", QV)
def _(t):
    d = I.conformalize(quant(t), "q05", "q95", "t", 0.1, 0.2)
    w = F.col("upper") - F.col("lower")
    g = d.agg(F.max("q_hat").alias("q_hat"), F.count("*").alias("n"), F.avg(F.col("t").between(F.col("lower_ms"), F.col("upper_ms")).cast("double")).alias("coverage_ms"),
              F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"), F.avg(w).alias("mean_width"), F.avg((w < 0.01).cast("double")).alias("frac_zero"))
    m = medians(d, [], median_width=w, median_ratio=w / F.greatest("y", F.lit(1e-6)))
    return with_scalar(g, m).select("n", *rsel("q_hat", "frac_zero"), *rsel("coverage_ms", "coverage", "median_ratio", d=3), *rsel("median_width", "mean_width", d=2))


@query("pi_conditional", "select method, count(*) as n, R(avg(case when y between lower and upper then 1.0 else 0.0 end), 3) as coverage from v_inv group by method having count(*) >= 10", QV)
def _(t):
    d = I.conformalize(quant(t), "q05", "q95", "t", 0.1, 0.2)
    return I.conditional_coverage(d, "method", "y").select("method", "n", *rsel("coverage", d=3))


@query("pi_rearrange", """select R(avg(case when t between a[1] and a[4] then 1.0 else 0.0 end)) as coverage_90, R(avg(case when t between a[2] and a[3] then 1.0 else 0.0 end)) as coverage_80,
    R(quantile_cont(a[4] - a[1], 0.5)) as width_90, R(quantile_cont(a[3] - a[2], 0.5)) as width_80 from (select t, list_sort([q05, q10, q90, q95]) as a from v_q)""", QV)
def _(t):
    d = I.rearrange(quant(t), ["q05", "q10", "q90", "q95"])
    g = d.agg(F.avg(F.col("t").between(F.col("q05"), F.col("q95")).cast("double")).alias("coverage_90"), F.avg(F.col("t").between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage_80"))
    m = medians(d, [], width_90=F.col("q95") - F.col("q05"), width_80=F.col("q90") - F.col("q10"))
    return with_scalar(g, m).select(*rsel("coverage_90", "coverage_80", "width_90", "width_80"))
