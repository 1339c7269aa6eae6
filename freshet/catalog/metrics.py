"""Aggregations: skill metrics and table summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.functions import transforms as X
from freshet.functions.basics import r, ratio, settle, spread_join, with_scalar
from freshet.operators import metrics as M, sampling as S
from freshet.operators.blocks import medians, modal, quantiles


def R2(y="y", p="p"):
    return f"(1 - sum(({y} - {p}) * ({y} - {p})) / greatest(var_pop({y}) * count({y}), 1e-10))"


def KGE(y="y", p="p"):
    return (f"(1 - sqrt(pow(covar_pop({y}, {p}) / nullif(stddev_pop({y}) * stddev_pop({p}), 0) - 1, 2) + "
            f"pow(stddev_pop({p}) / greatest(stddev_pop({y}), 1e-10) - 1, 2) + pow(avg({p}) / greatest(avg({y}), 1e-10) - 1, 2)))")


RMSE = "sqrt(avg((y - p) * (y - p)))"
PBIAS = "100 * (sum(p) - sum(y)) / greatest(sum(y), 1e-10)"


def LOGNSE(y="y", p="p"):
    return f"(1 - sum(pow(ln({y}) - ln({p}), 2)) / (var_pop(ln({y})) * count(*)))"


def AVGRANK(v, part=""):
    return (f"(rank() over ({('partition by ' + part) if part else ''} order by {v}) + (count(*) over (partition by "
            f"{part + ', ' if part else ''}{v}) - 1) / 2.0)")


def REPORT(by: str, src: str = "v_pred") -> str:
    """SQL for the full report per group."""
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    part = by
    join = f"using ({by})" if by else "on true"
    return f"""(select * from (select {keys} count(*) as n, {R2()} as nse, {LOGNSE()} as log_nse, {KGE()} as kge, {RMSE} as rmse,
      avg(case when p / y between 0.5 and 2 then 1.0 else 0.0 end) as frac_within_2x, (avg(p) - avg(y)) / avg(y) * 100 as bias_pct,
      quantile_cont(abs(y - p) / y * 100, 0.5) as mape_pct, quantile_cont(abs(y - p), 0.5) as median_abs_error from {src} {group}) a
      join (select {keys} covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0) as spearman_rho from (select {keys}
        {AVGRANK('y', part)} as ry, {AVGRANK('p', part)} as rp from {src}) {group}) s {join})"""


REPORT_COLS = ["nse", "log_nse", "kge", "rmse", "frac_within_2x", "bias_pct", "mape_pct", "median_abs_error", "spearman_rho"]


def rounded(names):
    return ", ".join(f"R({x}) as {x}" for x in names)


def rr(*names, digits=4):
    return [r(x, digits).alias(x) for x in names]


@query("agg_r2", f"select site, R({R2()}) as r2 from v_pred group by site")
def _(t):
    return M.site_skill(t.pred, ["site"], "y", "p", ["r2"]).select("site", *rr("r2"))


@query("agg_rmse", f"select site, R({RMSE}) as rmse from v_pred group by site")
def _(t):
    return M.site_skill(t.pred, ["site"], "y", "p", ["rmse"]).select("site", *rr("rmse"))


@query("agg_kge", f"""select site, R({KGE()}) as kge, R(covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p))) as kge_r,
    R(stddev_pop(p) / stddev_pop(y)) as kge_alpha, R(avg(p) / avg(y)) as kge_beta from v_pred group by site""")
def _(t):
    n = ["kge", "kge_r", "kge_alpha", "kge_beta"]
    return M.site_skill(t.pred, ["site"], "y", "p", n).select("site", *rr(*n))


@query("agg_pbias", f"select site, R({PBIAS}) as pbias from v_pred group by site")
def _(t):
    return M.site_skill(t.pred, ["site"], "y", "p", ["pbias"]).select("site", *rr("pbias"))


@query("agg_load_bias", "select site, R(100 * (sum(p * flow) - sum(y * flow)) / greatest(sum(y * flow), 1e-10)) as load_bias "
       "from v_pred group by site")
def _(t):
    d = t.pred.select("site", (F.col("y") * F.col("flow")).alias("y"), (F.col("p") * F.col("flow")).alias("p"))
    return M.site_skill(d, ["site"], "y", "p", ["pbias"]).select("site", r("pbias").alias("load_bias"))


@query("agg_storm_rmse", f"""select site, R({RMSE}) as storm_rmse from v_pred join
    (select site, quantile_cont(flow, 0.9) as q90 from v_pred group by site) using (site) where flow >= q90 group by site""")
def _(t):
    q = quantiles(t.pred, ["site"], {"q90": ("flow", 0.9)})
    d = spread_join(t.pred, q, ["site"]).where("flow >= q90")
    return M.site_skill(d, ["site"], "y", "p", ["rmse"]).select("site", r("rmse").alias("storm_rmse"))


@query("agg_picp", "select site, R(avg(case when y >= p * 0.8 and y <= p * 1.2 then 1.0 else 0.0 end)) as picp from v_pred group by site")
def _(t):
    inside = F.col("y").between(F.col("p") * 0.8, F.col("p") * 1.2)
    return t.pred.groupBy("site").agg(r(F.avg(inside.cast("double"))).alias("picp"))


STRATA = {"v_strata": """select *, case when flow < a then 'Q<50' when flow < b then 'Q50-90' else 'Q>90' end as stratum
    from v_pred join (select site, quantile_cont(flow, 0.5) as a, quantile_cont(flow, 0.9) as b from v_pred group by site) using (site)"""}


@query("agg_flow_strata", f"""select stratum, count(*) as n, R({R2()}) as r2, R({KGE()}) as kge, R({RMSE}) as rmse
    from v_strata group by stratum""", STRATA)
def _(t):
    d = M.flow_strata(t.pred, "site", "y", "p", "flow")
    s = M.site_skill(d, ["stratum"], "y", "p", ["n", "r2", "kge", "rmse"])
    few = F.col("n") < 5
    return s.select("stratum", "n", *[F.when(~few, r(x)).alias(x) for x in ("r2", "kge", "rmse")])


@query("agg_flow_counts", """select site, count(*) filter (stratum = 'Q<50') as n_low, count(*) filter (stratum = 'Q50-90') as n_mid,
    count(*) filter (stratum = 'Q>90') as n_high, count(*) filter (stratum = 'Q>90') < 3 as few_storms from v_strata group by site""", STRATA)
def _(t):
    d = M.flow_strata(t.pred, "site", "y", "p", "flow")
    k = lambda s: F.count_if(F.col("stratum") == s)
    return d.groupBy("site").agg(k("Q<50").alias("n_low"), k("Q50-90").alias("n_mid"), k("Q>90").alias("n_high")).withColumn(
        "few_storms", F.col("n_high") < 3)


BOOT = {
    "v_r2": f"select site, {R2()} as r2 from v_pred group by site",
    "v_num": "select site, r2, row_number() over (order by DRAW('42', site), site) as idx, count(*) over () as n_all from v_r2",
    "v_draws": """select rep, DRAW('42', rep, idx) % n_all + 1 as pick from
        (select idx, n_all, unnest(range(1, 1001)) as rep from v_num)""",
}


@query("agg_threshold_frac", """with b as (select rep, avg(case when r2 >= 0.7 then 1.0 else 0.0 end) as hi,
        avg(case when r2 < 0.5 then 1.0 else 0.0 end) as lo from v_draws join (select idx, r2 from v_num) on pick = idx group by rep)
    select R((select avg(case when r2 >= 0.7 then 1.0 else 0.0 end) from v_r2)) as gt_frac,
      R((select avg(case when r2 < 0.5 then 1.0 else 0.0 end) from v_r2)) as lt_frac,
      R(quantile_cont(hi, 0.025)) as gt_lo, R(quantile_cont(hi, 0.975)) as gt_hi,
      R(quantile_cont(lo, 0.025)) as lt_lo, R(quantile_cont(lo, 0.975)) as lt_hi from b""", BOOT)
def _(t):
    s = settle(M.site_skill(t.pred, ["site"], "y", "p", ["r2"]))  # numbered, drawn from and averaged
    gt, lt = F.avg((F.col("r2") >= 0.7).cast("double")), F.avg((F.col("r2") < 0.5).cast("double"))
    b = S.bootstrap_sums(s, "site", 42, 1000, [gt.alias("gt"), lt.alias("lt")])
    out = with_scalar(S.interval(b, ["gt", "lt"]), s.agg(gt.alias("gt_frac"), lt.alias("lt_frac")))
    return out.select(*rr("gt_frac", "lt_frac", "gt_lo", "gt_hi", "lt_lo", "lt_hi"))


@query("agg_snowdon", "select site, R(avg(y) / avg(p)) as factor from v_pred group by site")
def _(t):
    return t.pred.groupBy("site").agg(r(ratio(F.avg("y"), F.avg("p"))).alias("factor"))


@query("agg_duan", "select site, R(avg(exp(ln(1 + y) - ln(1 + p)))) as factor from v_pred group by site")
def _(t):
    return t.pred.groupBy("site").agg(r(F.avg(F.exp(F.log1p("y") - F.log1p("p")))).alias("factor"))


@query("agg_bcf_median", "select R(least(greatest(quantile_cont(y / greatest(p, 1e-6), 0.5), 0.5), 3.0)) as factor from v_pred")
def _(t):
    from freshet.functions.basics import clip

    q = medians(t.pred, [], m=F.col("y") / F.greatest("p", F.lit(1e-6)))
    return q.select(r(clip("m", 0.5, 3.0)).alias("factor"))


def _nat(kind, y, p):
    return (f"select '{kind}' as transform, R({R2('a', 'b')}) as r2_native, R(sqrt(avg((a - b) * (a - b))), 3) as rmse_native, "
            f"R(100 * (sum(b) - sum(a)) / greatest(sum(a), 1e-10)) as pbias_native from (select greatest({y}, 0) as a, greatest({p}, 0) as b from v_pred)")


@query("agg_native", " union all ".join([
    _nat("log1p", "exp(ln(1 + y)) - 1", "(exp(ln(1 + p)) - 1) * 1.1"), _nat("boxcox", "y", "p * 1.1"),
    _nat("sqrt", "sqrt(y) * sqrt(y)", "sqrt(p) * sqrt(p) * 1.1"), _nat("none", "y", "p * 1.1")]))
def _(t):
    from freshet.operators.evaluate import native_metrics

    parts = None
    for kind in ("log1p", "boxcox", "sqrt", "none"):
        d = t.pred.select(X.forward("y", kind, 0.2).alias("a"), X.forward("p", kind, 0.2).alias("b"))
        m = native_metrics(d, [], "a", "b", kind, 0.2, F.lit(1.1)).select(
            F.lit(kind).alias("transform"), r("r2_native").alias("r2_native"), r("rmse_native", 3).alias("rmse_native"),
            r("pbias_native").alias("pbias_native"))
        parts = m if parts is None else parts.unionByName(m)
    return parts


@query("agg_all", f"""select R({R2()}) as r2, R({RMSE}) as rmse, R({KGE()}) as kge, R({PBIAS}) as pbias, count(*) as n,
    R(100 * (sum(p * flow) - sum(y * flow)) / sum(y * flow)) as load_bias,
    R((select sqrt(avg((y - p) * (y - p))) from v_pred where flow >= (select quantile_cont(flow, 0.9) from v_pred))) as storm_rmse,
    R(avg(case when y between p * 0.8 and p * 1.2 then 1.0 else 0.0 end)) as picp from v_pred""")
def _(t):
    from freshet.operators.evaluate import all_metrics

    d = t.pred.withColumns({"lo": F.col("p") * 0.8, "hi": F.col("p") * 1.2})
    n = ["r2", "rmse", "kge", "pbias", "load_bias", "storm_rmse", "picp"]
    return all_metrics(d, "y", "p", "flow", "lo", "hi").select("n", *rr(*n))


@query("agg_site_metrics", f"select site, n, {rounded(REPORT_COLS)} from {REPORT('site')}")
def _(t):
    return M.full_report(t.pred, ["site"], "y", "p").select("site", "n", *rr(*REPORT_COLS))


@query("agg_site_slope", f"""select site, count(*) as n, R({R2()}) as r2, R(covar_pop(y, p) / var_pop(y)) as slope,
    R(avg(p) - avg(y)) as mean_bias, count(*) < 20 as low_sample from v_pred group by site""")
def _(t):
    d = M.site_skill(t.pred, ["site"], "y", "p", ["n", "r2", "slope", "mean_bias"])
    return d.select("site", "n", *rr("r2", "slope", "mean_bias"), (F.col("n") < 20).alias("low_sample"))


@query("agg_baselines", f"""with b as (select y, avg(y) over () as g, avg(y) over (partition by site) as s from v_pred)
    select 'global_mean' as predictor, R({R2('y', 'g')}) as nse, R(sqrt(avg((y - g) * (y - g)))) as rmse from b
    union all select 'site_mean', R({R2('y', 's')}), R(sqrt(avg((y - s) * (y - s)))) from b""")
def _(t):
    from freshet.operators.evaluate import baselines

    d = baselines(t.pred, "site", "y")
    return M.site_skill(d, ["predictor"], "y", "p", ["nse", "rmse"]).select("predictor", *rr("nse", "rmse"))


@query("agg_summary", f"""select n, {rounded(REPORT_COLS)}, R((select quantile_cont(r2, 0.5) from v_r2)) as median_site_r2,
    (select count(*) from v_r2) as n_sites from {REPORT('')}""", BOOT)
def _(t):
    pooled = M.full_report(t.pred, [], "y", "p")
    site = M.site_skill(t.pred, ["site"], "y", "p", ["nse"])
    top = with_scalar(medians(site, [], median_site_r2="nse"), site.agg(F.count("*").alias("n_sites")))
    return with_scalar(pooled, top).select("n", "n_sites", *rr(*REPORT_COLS, "median_site_r2"))


@query("agg_fold_summary", f"""select R(quantile_cont(r2, 0.5)) as r2, R(quantile_cont(kge, 0.5)) as kge, R(quantile_cont(rmse, 0.5)) as rmse,
      R(quantile_cont(pbias, 0.5)) as pbias, R(quantile_cont(factor, 0.5)) as factor, count(*) as n_folds,
      R((select quantile_cont(r2, 0.5) from v_r2)) as median_site_r2
    from (select site % 5 as fold, {R2()} as r2, {KGE()} as kge, {RMSE} as rmse, {PBIAS} as pbias,
      avg(exp(ln(1 + y) - ln(1 + p))) as factor from v_pred group by 1)""", BOOT)
def _(t):
    from freshet.operators.evaluate import fold_summary

    d = fold_summary(t.pred.withColumn("fold", F.col("site") % 5), "fold", "site", "y", "p")
    return d.select("n_folds", *rr("r2", "kge", "rmse", "pbias", "factor", "median_site_r2"))


@query("agg_pivot_compare", "select priority, " + ", ".join(
    f"R({e} filter (method = '{m}')) as {n}_{m}" for m in ("auto_point", "depth_integrated", "grab")
    for n, e in (("mean", "avg(y)"), ("sd", "stddev_pop(y)"), ("rows", "sum(1.0)"))) + " from v_pred group by priority")
def _(t):
    long = t.pred.groupBy("priority", "method").agg(
        F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.sum(F.lit(1.0)).alias("rows"))
    ms = ["auto_point", "depth_integrated", "grab"]
    p = long.groupBy("priority").pivot("method", ms).agg(*[F.first(x).alias(x) for x in ("mean", "sd", "rows")])
    return p.select("priority", *[r(f"{m}_{n}").alias(f"{n}_{m}") for m in ms for n in ("mean", "sd", "rows")])


@query("agg_region", f"""select region, count(*) as n_sites, R(quantile_cont(r2, 0.5)) as median_r2,
    R(quantile_cont(rmse, 0.5)) as median_rmse from (select site, {R2()} as r2, {RMSE} as rmse from v_pred group by site)
    join v_sites using (site) group by region order by median_r2 desc""")
def _(t):
    s = M.site_skill(t.pred, ["site"], "y", "p", ["r2", "rmse"]).join(t.sites.select("site", "region"), "site")
    n = s.groupBy("region").agg(F.count("*").alias("n_sites"))
    m = medians(s, ["region"], median_r2="r2", median_rmse="rmse")
    return n.join(m, "region").select("region", "n_sites", *rr("median_r2", "median_rmse")).orderBy(F.desc("median_r2"), "region")


@query("agg_site_chars", """select site, n, R(mean) as mean, R(std) as std, R(median) as median, family from
    (select site, count(*) as n, avg(y) as mean, stddev_samp(y) as std, quantile_cont(y, 0.5) as median from v_pred group by site)
    join (select site, family from (select site, family, count(*) as c from v_pred group by 1, 2)
      qualify row_number() over (partition by site order by c desc, family) = 1) using (site)""")
def _(t):
    a = t.pred.groupBy("site").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))
    d = a.join(medians(t.pred, ["site"], median="y"), "site").join(modal(t.pred, ["site"], "family", "family"), "site")
    return d.select("site", "n", *rr("mean", "std", "median"), "family")


@query("agg_calibration", """select * from (select site, count(*) as n_visits, R(quantile_cont(turb - y, 0.5)) as median_offset,
      R(stddev_samp(turb - y)) as std_offset, min(time) as first_visit, max(time) as last_visit from v_pred where y > 5 group by site)
    join (select site, family as sensor_family from (select site, family, count(*) as c from v_pred where y > 5 group by 1, 2)
      qualify row_number() over (partition by site order by c desc, family) = 1) using (site)""")
def _(t):
    from freshet.operators.calibration import calibration_pairs, calibration_summary

    d = t.pred.select("site", F.col("time").alias("visit_time"), F.col("turb").alias("field"), F.col("y").alias("sensor"), "family")
    s = calibration_summary(calibration_pairs(d, "field", "sensor"), "site", "visit_time", "family")
    return s.withColumns({x: r(x) for x in ("median_offset", "std_offset")})


@query("agg_extreme_summary", """select site, region, lat, count(*) as n_extreme, max(y) as max_y, R(quantile_cont(y, 0.5)) as median_y
    from v_pred join v_sites using (site) where y >= 400 group by site, region, lat order by max_y desc""")
def _(t):
    d = t.pred.where("y >= 400")
    a = d.groupBy("site").agg(F.count("*").alias("n_extreme"), F.max("y").alias("max_y"))
    a = a.join(medians(d, ["site"], median_y="y"), "site").join(t.sites.select("site", "region", "lat"), "site")
    return a.withColumn("median_y", r("median_y")).orderBy(F.desc("max_y"), "site")


@query("agg_running_median", """with l as (select log10(y) as ly, abs(y - p) / y * 100 as e, min(log10(y)) over () as lo, max(log10(y)) over () as hi from v_pred),
    b as (select cast(floor((ly - lo) / (hi - lo) * 19) as int) as bin, e from l)
    select bin, count(*) as n, case when count(*) >= 5 then R(quantile_cont(e, 0.5), 3) end as median_error from b where bin < 19 group by bin""")
def _(t):
    from freshet.operators.evaluate import log_bins

    d = log_bins(t.pred.select("y", (F.abs(F.col("y") - F.col("p")) / F.col("y") * 100).alias("e")), "y", 19).where("bin < 19")
    n = d.groupBy("bin").agg(F.count("*").alias("n"))
    m = medians(d, ["bin"], median_error="e")
    return n.join(m, "bin").select("bin", "n", F.when(F.col("n") >= 5, r("median_error", 3)).alias("median_error"))


@query("agg_hist2d", """with l as (select log10(turb) as a, log10(y) as b from v_pred), m as (select *, min(a) over () as a0, max(a) over () as a1,
      min(b) over () as b0, max(b) over () as b1 from l)
    select cast(least(floor((a - a0) / (a1 - a0) * 80), 79) as int) as xbin, cast(least(floor((b - b0) / (b1 - b0) * 80), 79) as int) as ybin,
      count(*) as n from m group by 1, 2""")
def _(t):
    from freshet.operators.evaluate import log_bins

    d = t.pred.select("turb", "y").where("turb > 0 and y > 0")
    d = log_bins(log_bins(d, "turb", 80, "xbin", True), "y", 80, "ybin", True)
    return d.groupBy("xbin", "ybin").agg(F.count("*").alias("n"))


@query("agg_hist", """with v as (select unnest(['raw', 'log1p', 'boxcox']) as panel, unnest([y, ln(1 + y), (pow(y, 0.2) - 1) / 0.2]) as x from v_pred where y > 0),
    m as (select panel, min(x) as lo, max(x) as hi, avg(x) as mu, stddev_pop(x) as sd from v group by panel),
    s as (select panel, avg(pow((x - mu) / sd, 3)) as skew from v join m using (panel) group by panel)
    select panel, cast(least(floor((x - lo) / (hi - lo) * 60), 59) as int) as bin, count(*) as n, R(any_value(skew)) as skew
    from v join m using (panel) join s using (panel) group by 1, 2""")
def _(t):
    panels = F.array(*[F.struct(F.lit(n).alias("panel"), e.alias("x")) for n, e in [
        ("raw", F.col("y")), ("log1p", F.log1p("y")), ("boxcox", (F.pow("y", F.lit(0.2)) - 1) / F.lit(0.2))]])
    v = t.pred.where("y > 0").select(F.inline(panels))
    skew = v.groupBy("panel").agg(F.skewness("x").alias("skew"))
    return M.histogram(v, ["panel"], "x", 60).join(F.broadcast(skew), "panel").select("panel", "bin", "n", *rr("skew"))  # 3 panels


FEATS = ["turb", "flow", "dry_days", "rain_mm"]


@query("agg_target_corr", " union all ".join(
    f"select '{f}' as feature, R(covar_pop({f}, ln(1 + y)) / nullif(stddev_pop({f}) * stddev_pop(ln(1 + y)), 0)) as corr from v_pred"
    for f in FEATS))
def _(t):
    from freshet.operators.evaluate import target_correlations

    d = target_correlations(t.pred.withColumn("ly", F.log1p("y")), FEATS, "ly")
    return d.select("feature", r("corr").alias("corr")).orderBy("corr")


@query("agg_missing", " union all ".join(
    f"select '{x}' as col, R(avg(case when {x} is null then 0.0 else 1.0 end) * 100) as pct_complete from v_labraw"
    for x in ("condition", "equipment", "limit_a", "limit_b", "start_time", "start_tz")))
def _(t):
    from freshet.operators.quality import completeness

    return completeness(t.labraw.select("condition", "equipment", "limit_a", "limit_b", "start_time", "start_tz")).select(
        "col", r("pct_complete").alias("pct_complete"))


PRI = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unset", "5-LOW": "low"}


@query("agg_class_pct", "select site, " + ", ".join(
    f"R(100.0 * count(*) filter (priority = '{k}') / count(*)) as {v}_pct" for k, v in PRI.items())
    + ", R(100.0 * count(*) filter (priority in ('1-URGENT', '2-HIGH')) / count(*)) as top_pct from v_pred group by site")
def _(t):
    from freshet.operators.attributes import class_percent

    d = class_percent(t.pred, ["site"], "priority", {k: f"{v}_pct" for k, v in PRI.items()}, {"top_pct": ["urgent_pct", "high_pct"]})
    return d.select("site", *rr(*[f"{v}_pct" for v in PRI.values()], "top_pct"))


@query("agg_area_pct", """select site, """ + ", ".join(
    f"R(coalesce(sum(y) filter (status = '{s}'), 0) / greatest(any_value(area) * 10, sum(y)) * 100) as pct_{s.lower()}" for s in "FOP")
    + " from v_pred join v_sites using (site) group by site")
def _(t):
    from freshet.operators.attributes import area_percent

    d = area_percent(t.pred, t.sites.select("site", (F.col("area") * 10).alias("basin")), "site", "status", "y", "basin",
                     {s: f"pct_{s.lower()}" for s in "FOP"})
    return d.select("site", *rr("pct_f", "pct_o", "pct_p"))
