"""Linear fits and site adaptation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from freshet.catalog.joins import rsel
from freshet.catalog.metrics import KGE, R2, REPORT, REPORT_COLS
from freshet.catalog.registry import query
from freshet.catalog.sampling import CAL, lines
from freshet.functions.basics import r, ratio, settle, sig, stored, with_scalar
from freshet.operators import adapt as AD, metrics as M, regression as G, sampling as S, trials as T
from freshet.operators.blocks import medians

SPLIT = {"v_split": """select *, ln(1 + turb) as lx, ln(1 + y) as ly, row_number() over (partition by site order by time, oid) <= floor(count(*) over (partition by site) * 0.7::double) as is_train from v_pred""",
         "v_site_fit": "select site, covar_pop(lx, ly) / var_pop(lx) as slope, avg(ly) - covar_pop(lx, ly) / var_pop(lx) * avg(lx) as intercept from v_split where is_train group by site"}


def split(t):
    return S.temporal_split(t.pred.select("site", "oid", "time", "y", "turb", "flow"), "site", "time", "oid")


@query("reg_site_ols", f"""select site, n, R(slope) as slope, R(intercept) as intercept, R(r2) as r2 from v_site_fit join (select site, count(*) as n from v_split group by site having count(*) >= 10) using (site)
    join (select site, {R2('ly', '(intercept + slope * lx)')} as r2 from v_split join v_site_fit using (site) where not is_train group by site) using (site)""", SPLIT)
def _(t):
    return G.site_lines(split(t), "site", F.log1p("turb"), F.log1p("y")).select("site", "n", *rsel("slope", "intercept", "r2"))


POOL = {**SPLIT, "v_pool": "select covar_pop(lx, ly) / var_pop(lx) as slope, avg(ly) - covar_pop(lx, ly) / var_pop(lx) * avg(lx) as intercept from v_split where is_train",
        "v_sm": "select *, (select avg(exp(ly - intercept - slope * lx)) from v_split, v_pool where is_train) as sm from v_pool",
        "v_pt": "select site, ly, intercept + slope * lx as lp, exp(ly) - 1 as yn, greatest((exp(intercept + slope * lx) - 1) * sm, 0) as pn from v_split, v_sm where not is_train"}


@query("reg_global_pooled", f"""select coalesce(cast(site as varchar), 'ALL') as site, count(*) as n_test, R({R2('ly', 'lp')}) as r2_log, R({R2('yn', 'pn')}) as r2_native
    from v_pt group by rollup(site) having count(*) >= 3""", POOL)
def _(t):
    return G.pooled_line(split(t), "site", F.log1p("turb"), F.log1p("y")).select("site", "n_test", *rsel("r2_log", "r2_native"))


@query("reg_global_logo", f"""with f as (select s.site as out, covar_pop(lx, ly) / var_pop(lx) as slope, avg(ly) - covar_pop(lx, ly) / var_pop(lx) * avg(lx) as intercept
      from (select distinct site from v_pred) s join v_split p on p.site <> s.site group by s.site)
    select site, count(*) as n_test, R(any_value(slope), 6) as slope, R({R2('ly', '(intercept + slope * lx)')}) as r2 from v_split join f on out = site group by site""", SPLIT)
def _(t):
    return G.leave_site_out(t.pred, "site", F.log1p("turb"), F.log1p("y")).select("site", "n_test", r("slope", 6).alias("slope"), r("r2").alias("r2"))


@query("reg_multi_linear", f"""with m as (select var_pop(lx) as a, covar_pop(lx, flow) as b, var_pop(flow) as c, covar_pop(lx, ly) as d, covar_pop(flow, ly) as e, avg(lx) as mx, avg(flow) as mf, avg(ly) as my from v_split where is_train),
    w as (select (d * c - b * e) / (a * c - b * b) as w1, (a * e - b * d) / (a * c - b * b) as w2, mx, mf, my from m),
    p as (select site, ly, my + w1 * (lx - mx) + w2 * (flow - mf) as lp from v_split, w where not is_train)
    select coalesce(cast(site as varchar), 'ALL') as site, count(*) as n_test, R({R2('ly', 'lp')}) as r2 from p group by rollup(site) having count(*) >= 3""", SPLIT)
def _(t):
    from freshet.plans.models import multi_linear

    d = split(t).withColumns({"lx": F.log1p("turb"), "ly": F.log1p("y")})
    return multi_linear(d, "site", ["lx", "flow"], "ly", "is_train").select("site", "n_test", r("r2").alias("r2"))


RIDGE_KINDS = {"sqrt": None, "log1p": None, "boxcox": 0.2}
RIDGE = {
    "v_rb": "select site, case when oid % 29 = 0 then null else y end as yy, case when oid % 13 = 0 then null else turb end as a, case when oid % 17 = 0 then null else flow end as b, 1 + oid % 3 as w from v_pred",
    "v_rm": "select quantile_cont(a, 0.5) as ma, quantile_cont(b, 0.5) as mb from v_rb where yy is not null",
    "v_rr": """select site, kind, yy as yn, case kind when 'sqrt' then sqrt(yy) when 'log1p' then ln(1 + yy) else (pow(1 + yy, 0.2::double) - 1) / 0.2::double end as yt,
      coalesce(a, ma) as x1, coalesce(b, mb) as x2, cast(w as double) as w from v_rb, v_rm, (select unnest(['sqrt', 'log1p', 'boxcox']) as kind) where yy is not null""",
    "v_ro": """select site, kind, sum(w) as n, sum(w * x1) as s1, sum(w * x2) as s2, sum(w * yt) as sy, sum(w * x1 * x1) as s11, sum(w * x1 * x2) as s12, sum(w * x2 * x2) as s22,
      sum(w * x1 * yt) as s1y, sum(w * x2 * yt) as s2y from v_rr group by 1, 2""",
    "v_rt": "select site, kind, " + ", ".join(f"sum({x}) over (partition by kind) - {x} as {x}" for x in ("n", "s1", "s2", "sy", "s11", "s12", "s22", "s1y", "s2y")) + " from v_ro",
    "v_rc": "select site, kind, s1 / n as m1, s2 / n as m2, sy / n as my, s11 - s1 * s1 / n + 1 as c11, s12 - s1 * s2 / n as c12, s22 - s2 * s2 / n + 1 as c22, s1y - s1 * sy / n as c1y, s2y - s2 * sy / n as c2y from v_rt",
    "v_rf": """select site, kind, b1, b2, my - b1 * m1 - b2 * m2 as b0 from (select *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) as b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) as b2 from v_rc)""",
    "v_rx": """select site, kind, case when kind = 'log1p' then avg(e) else avg(yn) / avg(case kind when 'sqrt' then p * p else least(greatest(pow(greatest(p, -5 + 1e-10) * 0.2 + 1, 5) - 1, 0), 1e8) end) end as factor
      from (select f.site, f.kind, yn, b0 + b1 * x1 + b2 * x2 as p, exp(yt - (b0 + b1 * x1 + b2 * x2)) as e from v_rr r join v_rf f on r.kind = f.kind and r.site <> f.site) group by 1, 2""",
    "v_rp": """select site, kind, yt, yn, p, greatest(factor * case kind when 'sqrt' then p * p when 'log1p' then exp(p) - 1 else least(greatest(pow(greatest(p, -5 + 1e-10) * 0.2 + 1, 5) - 1, 0), 1e8) end, 0) as pn, factor
      from (select r.*, b0 + b1 * x1 + b2 * x2 as p, factor from v_rr r join v_rf using (site, kind) join v_rx using (site, kind))""",
}


@query("reg_ridge_logo", f"""select kind, site, count(*) as n, SIG({R2('yt', 'p')}, 5) as r2, SIG({KGE('yt', 'p')}, 5) as kge, SIG({R2('yn', 'pn')}, 5) as r2_native, SIG(sqrt(avg(pow(yn - pn, 2))), 5) as rmse_native,
    SIG(100 * (sum(pn) - sum(yn)) / sum(yn), 5) as pbias_native, SIG(max(factor), 5) as factor from v_rp group by kind, site having count(*) >= 5""", RIDGE)
def _(t):
    """Three targets, two features with gaps, weighted rows and rows without a target."""
    some = lambda x, k: F.when(F.col("oid") % k != 0, F.col(x))
    d = t.pred.select("site", some("y", 29).alias("y"), some("turb", 13).alias("a"), some("flow", 17).alias("b"), (1 + F.col("oid") % 3).alias("w"))
    out = [G.ridge_logo(d, "site", ["a", "b"], {}, "y", kind=k, lam=lam, weight="w").withColumn("kind", F.lit(k)) for k, lam in RIDGE_KINDS.items()]
    cols = ["r2", "kge", "r2_native", "rmse_native", "pbias_native", "factor"]
    return reduce(lambda x, z: x.unionByName(z), out).select("kind", "site", "n", *[sig(x, 5).alias(x) for x in cols])


@query("reg_site_slopes", """with s as (select site, count(*) as n, covar_pop(log10(turb), log10(y)) / nullif(var_pop(log10(turb)), 0) as slope from v_pred where y > 0 and turb > 0 group by site having count(*) >= 5)
    select site, n, R(slope) as slope, R((select quantile_cont(slope, 0.5) from s)) as median_slope from s where slope is not null""")
def _(t):
    d = t.pred.where("y > 0 and turb > 0")
    s = G.line_fit(d, ["site"], F.log10("turb"), F.log10("y"), 5).where("slope is not null")
    return with_scalar(s, medians(s, [], median_slope="slope")).select("site", F.col("n_fit").alias("n"), *rsel("slope", "median_slope"))


CR = {"v_cr": "select c.mode, c.n, c.trial, site, ln(1 + p) as pm, ln(1 + y) as tm, turb as x, y from v_cal c join v_pred using (site, oid)"}
GK = "mode, n, trial, site"
LIN = {**CR, "v_l1": f"select {GK}, count(*) as k, avg(pm) as mp, avg(tm) as mt, covar_pop(pm, tm) as cov, var_pop(pm) as var from v_cr group by all",
       "v_l2": f"select {GK}, a, mt - a * mp as b from (select *, case when k <= 1 or var <= 1e-12 then 1.0::double else least(greatest(cov / nullif(var, 0), 0.1), 10) end as a from v_l1)",
       "v_fit": f"""select {GK}, a, b, case when avg(exp(a * pm + b) - 1) > 0 then least(greatest(avg(exp(tm) - 1) / avg(exp(a * pm + b) - 1), 0.1), 10) else 1 end as f
         from v_cr join v_l2 using ({GK}) group by {GK}, a, b union all select unnest({T.MODES!r}), 0, 1, site, 1, 0, 1 from v_cnt"""}
PREDS = {"v_pr": f"select {GK}, y, greatest(exp(a * ln(1 + p) + b) - 1, 0) * f as pr from v_test join v_pred using (site, oid) join v_fit using ({GK})"}
TS = {"v_ta": f"""select {GK}, count(*) as n_test, case when var_pop(y) * count(*) >= 1e-10 then {R2('y', 'pr')} end as nse,
        case when count(*) filter (pr > 0) >= 2 and var_pop(ln(y)) filter (pr > 0) * count(*) filter (pr > 0) > 1e-10
          then 1 - sum(pow(ln(y) - ln(pr), 2)) filter (pr > 0) / (var_pop(ln(y)) filter (pr > 0) * count(*) filter (pr > 0)) end as log_nse,
        case when stddev_pop(pr) >= 1e-10 and stddev_pop(y) >= 1e-10 then 1 - sqrt(pow(covar_pop(y, pr) / nullif(stddev_pop(y) * stddev_pop(pr), 0) - 1, 2) + pow(stddev_pop(pr) / greatest(stddev_pop(y), 1e-10) - 1, 2)
          + pow(avg(pr) / greatest(avg(y), 1e-10) - 1, 2)) end as kge, sqrt(avg(pow(y - pr, 2))) as rmse, quantile_cont(abs(y - pr) / y * 100, 0.5) as mape_pct,
        avg(case when pr / y between 0.5 and 2 then 1.0 else 0.0 end) as frac_within_2x, (avg(pr) - avg(y)) / avg(y) * 100 as bias_pct, quantile_cont(abs(y - pr), 0.5) as median_abs_error
        from v_pr group by all having count(*) >= 2""",
      "v_tn": f"select {GK}, {R2('y', 'pr')} as nse from v_pr group by all having count(*) >= 2 and var_pop(y) * count(*) >= 1e-10",
      "v_rk": f"""select {GK}, rank() over (partition by {GK} order by y) + (count(*) over (partition by {GK}, y) - 1) / 2.0 as ry,
        rank() over (partition by {GK} order by pr) + (count(*) over (partition by {GK}, pr) - 1) / 2.0 as rp from v_pr""",
      "v_rho": f"select {GK}, covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0) as spearman_rho from v_rk group by all",
      "v_ts": f"select v_ta.*, spearman_rho from v_ta join v_rho using ({GK})"}
TSC = T.SCORES
SCALED = ["nse", "log_nse", "kge", "rmse", "mape_pct", "bias_pct", "median_abs_error"]  # to significant digits: their size varies


def shown(names, prefix=""):
    return ", ".join(f"{'SIG' if x in SCALED else 'R'}({prefix}{x}) as {prefix}{x}" for x in names)


def show(prefix=""):
    return [(sig if x in SCALED else r)(prefix + x).alias(prefix + x) for x in TSC]


PS = {"v_ps": f"select mode, n, site, count(*) as n_trials, {', '.join(f'quantile_cont({c}, 0.5) as {c}' for c in TSC)} from v_ts where nse is not null group by mode, n, site",
      "v_pn": "select mode, n, site, quantile_cont(nse, 0.5) as nse from v_tn group by mode, n, site"}
PSQ = f"select mode, n, site, n_trials, {shown(TSC)} from v_ps"


def score(t, fit, predict, used=("y", "p"), sizes=T.SIZES, trials=T.TRIALS, modes=T.MODES, names=TSC, over=True):
    return T.site_scores(lines(t), "site", "oid", "time", ["x", "y", "p", "t"], sizes, trials, list(modes), 7, fit, predict, used, list(names), over)


def per_site(scores):
    return scores.select("mode", "n", "site", "n_trials", *show())


BENCH = ("random", "temporal")
SOME = CAL(T.SIZES[1:], T.TRIALS, BENCH)


@query("reg_ols_benchmark", PSQ, {**SOME, **CR, **TS, **PS,
       "v_b1": f"select {GK}, count(*) as k, avg(ln(1 + x)) as mx, avg(tm) as mt, covar_pop(ln(1 + x), tm) as cov, var_pop(ln(1 + x)) as var, avg(y) as my, any_value(y / x) as q from v_cr group by all",
       "v_b2": "select *, cov / nullif(var, 0) as a, mt - cov / nullif(var, 0) * mx as b from v_b1",
       "v_fit": f"select {GK}, k, any_value(my) as my, any_value(q) as q, any_value(var) as var, a, b, least(greatest(avg(exp(least(tm - b - a * ln(1 + x), 700))), 0.5), 5) as f from v_cr join v_b2 using ({GK}) group by {GK}, k, a, b",
       "v_pr": f"select {GK}, y, case when k = 1 then turb * q when var <= 1e-12 then my else greatest((exp(least(greatest(b + a * ln(1 + turb), 0), 20)) - 1) * f, 0) end as pr from v_test join v_pred using (site, oid) join v_fit using ({GK})"})
def _(t):
    return per_site(score(t, T.fit_benchmark, T.benchmark_matrix, ("y", "x"), T.SIZES[1:], T.TRIALS, BENCH))


# a line through two close points can leave the range of doubles; such a trial has no defined score on either side
@query("reg_ols_positive", PSQ, {**SOME, **CR, **TS, **PS,
       "v_b1": f"select {GK}, count(*) as k, avg(ln(x)) as mx, avg(ln(y)) as mt, covar_pop(ln(x), ln(y)) as cov, var_pop(ln(x)) as var, any_value(y / x) as q from v_cr group by all",
       "v_b2": "select *, case when k > 1 and var <= 1e-12 then 0 else cov / var end as a from v_b1",
       "v_p0": f"select {GK}, y, case when k = 1 then ln(turb * q) else a * ln(turb) + mt - a * mx end as lp from v_test join v_pred using (site, oid) join v_b2 using ({GK})",
       "v_p1": f"select {GK} from v_p0 group by all having max(lp) > 354",
       "v_pr": f"select {GK}, y, exp(lp) as pr from v_p0 anti join v_p1 using ({GK})"})
def _(t):
    return per_site(score(t, T.fit_positive, T.positive_matrix, ("y", "x"), T.SIZES[1:], T.TRIALS, BENCH))


@query("reg_slope_correction", """select oid, R(a * ln(1 + p) + b) as corrected from v_pred, (select covar_pop(ln(1 + p), ln(1 + y)) / var_pop(ln(1 + p)) as a,
    avg(ln(1 + y)) - covar_pop(ln(1 + p), ln(1 + y)) / var_pop(ln(1 + p)) * avg(ln(1 + p)) as b from v_pred)""")
def _(t):
    d = t.pred.select("oid", F.log1p("y").alias("ty"), F.log1p("p").alias("tp"))
    return G.slope_correction(d, "ty", "tp").select("oid", *rsel("corrected"))


def _finer(k: int, step: float) -> str:
    """SQL: likelihood at 21 points around the best one of the level before."""
    return f"""select lam, (lam - 1) * sum(l) - count(*) / 2.0::double * ln(var_pop((exp(lam * l) - 1) / lam)) as llf
      from (select l, (select lam from v_k{k - 1} order by llf desc limit 1) + unnest(range(-10, 11)) * {step!r}::double as lam from v_kl) where abs(lam) > 1e-9 group by lam"""


LAMBDA = {"v_kl": "select ln(1 + y) as l from v_pred", "v_k0": "select 0.0::double as lam, 0.0::double as llf", "v_k1": _finer(1, 0.2037), "v_k2": _finer(2, 0.0203), "v_k3": _finer(3, 0.00201), "v_k4": _finer(4, 0.0002)}


@query("reg_boxcox_lambda", """select R(lam + 0.0001::double * (fm - fp) / nullif(fm - 2 * llf + fp, 0), 5) as lam
    from (select lam, llf, lag(llf) over (order by lam) as fm, lead(llf) over (order by lam) as fp from v_k4) order by llf desc limit 1""", LAMBDA)
def _(t):
    return G.boxcox_lambda(t.pred, "y").select(r("lam", 5).alias("lam"))


CMP = {**CAL([10], 50, ("random",)), **CR,
       "v_l1": f"select {GK}, avg(pm) as mp, avg(tm) as mt, covar_pop(pm, tm) / var_pop(pm) as s, covar_pop(log10(x), log10(y)) / var_pop(log10(x)) as us, avg(log10(x)) as ux, avg(log10(y)) as uy from v_cr group by all",
       "v_l2": f"select {GK}, least(greatest(s, 0.1), 10) as a, mt - s * mp as b, us, uy - us * ux as ub from v_l1",
       "v_fit": f"""select {GK}, a, b, us, ub, least(greatest(avg(exp(tm) - 1) / avg(greatest(exp(a * pm + b) - 1, 1e-6)), 0.1), 10) as f, avg(pow(10.0, log10(y) - ub - us * log10(x))) as uf
         from v_cr join v_l2 using ({GK}) group by {GK}, a, b, us, ub""",
       "v_pr": f"""select {GK}, y, greatest(exp(a * ln(1 + p) + b) - 1, 0) * f as o, pow(10.0, ub + us * log10(turb)) * uf as u from v_test join v_pred using (site, oid) join v_fit using ({GK})""",
       "v_ct": f"""select {GK}, {R2('y', 'u')} as usgs_r2, {R2('y', 'o')} as ours_r2, covar_pop(y, u) / var_pop(y) as usgs_slope, covar_pop(y, o) / var_pop(y) as ours_slope,
         sqrt(avg(pow(y - u, 2))) as usgs_rmse, sqrt(avg(pow(y - o, 2))) as ours_rmse from v_pr group by all"""}
CC = ["usgs_r2", "ours_r2", "usgs_slope", "ours_slope", "usgs_rmse", "ours_rmse"]


@query("reg_usgs_compare", f"select site, {', '.join(f'R(quantile_cont({c}, 0.5)) as {c}' for c in CC)}, R(quantile_cont(ours_r2, 0.5) - quantile_cont(usgs_r2, 0.5)) as r2_advantage, "
       "R(quantile_cont(usgs_rmse, 0.5) - quantile_cont(ours_rmse, 0.5)) as rmse_advantage from v_ct group by site", CMP)
def _(t):
    return usgs_compare(t).select("site", *rsel(*CC, "r2_advantage", "rmse_advantage"))


def usgs_compare(t):
    from freshet.plans.compare import curve_versus_model

    return curve_versus_model(lines(t), "site", "oid", "time", ["x", "y", "p", "t"], [10], T.TRIALS, ["random"], 7)


@query("adapt_none", "select oid, R(greatest(exp(ln(1 + p)) - 1, 0) * (select avg(y) / avg(p) from v_pred), 3) as pred from v_pred")
def _(t):
    from freshet.functions import transforms as X
    from freshet.functions.basics import clip

    d = with_scalar(t.pred.select("oid", F.log1p("p").alias("pm")), t.pred.agg(ratio(F.avg("y"), F.avg("p")).alias("f")))
    return d.select("oid", r(clip(X.inverse("pm", "log1p"), 0) * F.col("f"), 3).alias("pred"))


@query("adapt_linear", PSQ, {**CAL(), **LIN, **PREDS, **TS, **PS})
def _(t):
    return per_site(score(t, T.fit_linear, T.line_matrix()))


def SHRINK(src: str, k: float = 15, extra: str = "") -> str:
    """SQL: shrunk mean of column res per calibration set."""
    return f"""select {GK}{extra}, kk, kk / (kk + {k} * least(greatest(5 / (4 + z * z), 0.1), 1)) * raw as delta from (select *, abs(raw) / (case when kk = 1 then 1 when mad > 0 then mad * 1.4826 when sd > 0 then sd else 1 end / sqrt(kk)) as z
      from (select {GK}{extra}, count(*) as kk, avg(res) as raw, stddev_pop(res) as sd, quantile_cont(abs(res - med), 0.5) as mad from (select *, quantile_cont(res, 0.5) over (partition by {GK}) as med from {src}) group by {GK}{extra}))"""


@query("adapt_shrinkage", f"select {GK}, kk as n_cal, SIG(delta) as delta from v_sh", {**CAL(T.SIZES[1:]), **CR, "v_res": "select *, tm - pm as res from v_cr", "v_sh": SHRINK("v_res")})
def _(t):
    d = T.shrunk_offsets(lines(t), "site", "oid", "time", "t", "p", T.SIZES[1:], T.TRIALS, list(T.MODES), 7, 15, 4, "delta")
    return d.select("mode", "n", "trial", "site", "n_cal", sig("delta").alias("delta"))


BAY = {**CR, "v_l1": LIN["v_l1"],
       "v_l2": f"select {GK}, k, case when k >= 10 then 1 + k / (k + 10.0::double) * (case when var <= 1e-12 then 1 else least(greatest(cov / nullif(var, 0), 0.1), 10) end - 1) else 1 end as a from v_l1",
       "v_res": f"select v_cr.*, a, tm - a * pm as res from v_cr join v_l2 using ({GK})",
       "v_l3": SHRINK("v_res", extra=", a"),
       "v_fit0": f"""select {GK}, a, delta as b, 1 + kk / (kk + 45.0::double) * (least(greatest(avg(exp(tm) - 1) / avg(greatest(exp(a * pm + delta) - 1, 1e-6)), 0.1), 10) - 1) as f
         from v_cr join v_l3 using ({GK}) group by {GK}, a, delta, kk"""}


def BAYES(sizes=T.SIZES, trials=T.TRIALS, modes=tuple(T.MODES)):
    zero = f" union all select unnest({list(modes)!r}), 0, 1, site, 1, 0, 1 from v_cnt" if 0 in sizes else ""
    return {**CAL(sizes, trials, modes), **BAY, "v_fit": f"select {GK}, a, b, f from v_fit0{zero}", **PREDS, **TS, **PS}


def bayes_scores(t, sizes=T.SIZES, names=TSC):
    return score(t, T.fit_bayes, T.line_matrix(), sizes=sizes, names=names)


@query("adapt_bayes", PSQ, BAYES())
def _(t):
    return per_site(bayes_scores(t))


@query("adapt_random_intercept", """with s as (select site, count(*) as n, avg(ln(1 + y) - ln(1 + p)) as m, var_pop(ln(1 + y) - ln(1 + p)) as v from v_pred group by site),
    c as (select greatest(sum(v * n) filter (n > 1) / greatest(sum(n - 1) filter (n > 1), 1), 1e-6) as s2, var_pop(m) as vm, avg(1.0::double / n) as inv from s),
    d as (select s2, greatest(vm - s2 * inv, 1e-6) as dd from c)
    select site, n, R(dd / (dd + s2 / n), 6) as shrinkage, R(dd / (dd + s2 / n) * m, 6) as intercept from s, d""")
def _(t):
    d = t.pred.select("site", (F.log1p("y") - F.log1p("p")).alias("res"))
    return AD.random_intercepts(d, d, "site", "res").select("site", "n", *rsel("shrinkage", "intercept", d=6))


CV = {**BAYES(),
      "v_cn": "select mode, n, site, nse, row_number() over (partition by mode, n order by DRAW('42', site), site) as rn, count(*) over (partition by mode, n) as m from v_ps where nse is not null",
      "v_cb": """select mode, n, rep, quantile_cont(b.nse, 0.5) as x from (select mode, n, rep, DRAW('42', rep, rn) % m + 1 as pick from (select mode, n, rn, m, unnest(range(1, 1001)) as rep from v_cn)) a
        join (select mode, n, rn, nse from v_cn) b using (mode, n) where b.rn = a.pick group by 1, 2, 3"""}


@query("adapt_curve", f"select mode, n, n_sites, {shown(TSC, 'median_')}, SIG(ci_lo) as ci_lo, SIG(ci_hi) as ci_hi from (select mode, n, count(*) as n_sites, " + ", ".join(f"quantile_cont({c}, 0.5) as median_{c}" for c in TSC) + " from v_ps group by 1, 2) join "
       "(select mode, n, quantile_cont(x, 0.025) as ci_lo, quantile_cont(x, 0.975) as ci_hi from v_cb group by 1, 2) using (mode, n)", CV)
def _(t):
    d = AD.curve(settle(bayes_scores(t)), "site", TSC, ["mode", "n"])
    return d.select("mode", "n", "n_sites", *show("median_"), sig("ci_lo").alias("ci_lo"), sig("ci_hi").alias("ci_hi"))


EFF = {**CAL(T.SIZES[1:], T.TRIALS, BENCH), **LIN, **PREDS, **TS}


@query("adapt_effort_curve", "select mode, n, SIG(quantile_cont(nse, 0.5)) as nse_median, SIG(quantile_cont(nse, 0.25)) as nse_q25, SIG(quantile_cont(nse, 0.75)) as nse_q75, count(distinct site) as n_sites from v_tn group by 1, 2", EFF)
def _(t):
    s = score(t, T.fit_linear, T.line_matrix(), sizes=T.SIZES[1:], modes=BENCH, names=["nse"], over=False).where("nse is not null")
    d = AD.effort(s, ["mode", "n"], "site", "nse")
    return d.select("mode", "n", "n_sites", *[sig(f"nse_{x}").alias(f"nse_{x}") for x in ("median", "q25", "q75")])


@query("adapt_monotone", "select mode, n_before, n, SIG(d, 4) as decrease from (select mode, n, lag(n) over (partition by mode order by n) as n_before, lag(m) over (partition by mode order by n) - m as d from (select mode, n, quantile_cont(nse, 0.5) as m from v_pn group by 1, 2)) where d > 0", BAYES())
def _(t):
    s = bayes_scores(t, names=["nse"])
    return AD.monotone_breaks(medians(stored(s.select("mode", "n", "nse")), ["mode", "n"], m="nse"), ["mode"], "n", "m").withColumn("decrease", sig("decrease", 4))


@query("adapt_delta", "select mode, site, SIG(a.nse) as zero_shot, SIG(b.nse - a.nse, 4) as gain from v_pn a join v_pn b using (mode, site) where a.n = 0 and b.n = 10", BAYES([0, 10]))
def _(t):
    ps = bayes_scores(t, [0, 10], ["nse"])
    w = ps.groupBy("mode", "site").agg(F.max(F.when(F.col("n") == 0, F.col("nse"))).alias("zero_shot"), F.max(F.when(F.col("n") == 10, F.col("nse"))).alias("at10"))
    return w.where("zero_shot is not null and at10 is not null").select("mode", "site", sig("zero_shot").alias("zero_shot"), sig(F.col("at10") - F.col("zero_shot"), 4).alias("gain"))


AT = [(m, n) for m in T.MODES for n in T.SIZES]


@query("agg_per_site_report", f"""select site, a.n as n_samples, {', '.join(f'R({c}) as {c}' for c in REPORT_COLS)}, {', '.join(f'r2_{m}_at_{n}' for m, n in AT)} from {REPORT('site')} a
    left join (select site, """ + ", ".join(f"SIG(max(nse) filter (mode = '{m}' and n = {n})) as r2_{m}_at_{n}" for m, n in AT) + " from v_pn group by site) using (site)", BAYES())
def _(t):
    ps = bayes_scores(t, names=["nse"])
    wide = ps.groupBy("site").agg(*[sig(F.max(F.when((F.col("mode") == m) & (F.col("n") == n), F.col("nse")))).alias(f"r2_{m}_at_{n}") for m, n in AT])
    rep = M.full_report(t.pred, ["site"], "y", "p").select("site", F.col("n").alias("n_samples"), *rsel(*REPORT_COLS))
    return rep.join(wide, "site", "left")
