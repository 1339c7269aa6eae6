"""Breakdowns of skill, importance, applicability."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.joins import rsel
from freshet.catalog.metrics import R2
from freshet.catalog.registry import query
from freshet.functions import transforms as X
from freshet.functions.basics import draw, r
from freshet.operators import diagnostics as D, metrics as M

PC = [c for c in D.PACK if c != "n"]
PSQL = (f"count(*) as n, R(case when count(*) >= 2 then {R2()} end) as r2, R(sqrt(avg((y - p) * (y - p)))) as rmse, R(quantile_cont(abs(y - p) / y * 100, 0.5)) as mape_pct, "
        "R(avg(case when p / y between 0.5 and 2 then 100.0 else 0.0 end)) as within_2x_pct, R(avg(y)) as mean_true, R(avg(p)) as mean_pred, "
        "R(quantile_cont(abs(y - p), 0.5)) as median_abs_error, R((avg(p) - avg(y)) / avg(y) * 100) as bias_pct")
CSQL = (PSQL + ", R(quantile_cont(y / greatest(turb, 1), 0.5)) as ratio_obs, R(quantile_cont(p / greatest(turb, 1), 0.5)) as ratio_pred, R(quantile_cont(p - y, 0.5)) as median_bias")
CC = [*PC, "ratio_obs", "ratio_pred", "median_bias"]


@query("dia_metrics", f"select method, {PSQL} from v_pred group by method")
def _(t):
    return D.pack(t.pred, ["method"], "y", "p").select("method", "n", *rsel(*PC))


BINR = lambda x, e, lab: "case " + " ".join(f"when {x} > {a} and {x} <= {b} then '{z}'" for a, b, z in zip(e, e[1:], lab)) + " end"
DV = {"v_st": "select site, stddev_samp(y) as sd, count(*) as ns from v_pred group by site",
      "v_sq4": "select quantile_cont(sd, 0.25) as a, quantile_cont(sd, 0.5) as b, quantile_cont(sd, 0.75) as c from v_st",
      "v_var": "select site, ns, case when sd <= a then 'Q1_low' when sd <= b then 'Q2_med' when sd <= c then 'Q3_high' else 'Q4_extreme' end as var from v_st, v_sq4",
      "v_long": f"""select y, p, unnest(['overall', 'method', 'region', 'family', 'geology', 'variability', 'sample_count', 'turb_tier', 'conc_tier']) as dimension,
        unnest(['ALL', method, region, family, cast(geol as varchar), var, {BINR('ns', [0, 10, 20, 50, 200, 1e300], ['1-10', '11-20', '21-50', '51-200', '200+'])},
          {BINR('turb', [0, 10, 50, 200, 1000, 1e300], ['<10', '10-50', '50-200', '200-1000', '>1000'])}, {BINR('y', [0, 50, 500, 5000, 1e300], ['low', 'med', 'high', 'extreme'])}]) as "group"
        from v_pred left join v_sites using (site) left join v_var using (site)"""}


@query("dia_disaggregate", f'select dimension, "group", {PSQL} from v_long where "group" is not null group by all', DV)
def _(t):
    d = t.pred.join(t.sites.select("site", "region", "geol"), "site", "left")
    plain = {"method": "method", "region": "region", "family": "family", "geology": "geol"}
    return D.disaggregate(d, "site", "y", "p", "turb", plain).select("dimension", "group", "n", *rsel(*PC))


def _show(d):
    return d.select("group", "n", *rsel(*CC))


@query("dia_first_flush", f"""select case when rain_mm <= (select quantile_cont(rain_mm, 0.25) from v_pred) and dry_days >= (select quantile_cont(dry_days, 0.75) from v_pred) then 'flush' else 'normal' end as "group",
    {CSQL} from v_pred group by 1""")
def _(t):
    return _show(D.contrast(D.first_flush(t.pred, "rain_mm", "dry_days"), "group", "y", "p", "turb"))


@query("dia_hysteresis", f"""select case when oid % 2 = 1 then 'rising' else 'falling' end as "group", {CSQL} from v_pred group by 1""")
def _(t):
    rising = F.when(F.col("oid") % 2 == 1, "rising").otherwise("falling")
    return _show(D.contrast(t.pred.withColumn("group", rising), "group", "y", "p", "turb"))


@query("dia_extremes", f"""with q as (select quantile_cont(turb, 0.99) as a, quantile_cont(turb, 0.95) as b from v_pred),
    g as (select v.*, 'top1' as "group" from v_pred v, q where turb >= a union all select v.*, 'top5' from v_pred v, q where turb >= b union all select v.*, 'bottom95' from v_pred v, q where turb < b)
    select "group", {CSQL} from g group by 1""")
def _(t):
    return _show(D.contrast(D.extremes(t.pred, "turb"), "group", "y", "p", "turb"))


@query("dia_snowmelt", f"""select case when sin(2 * pi() * dayofyear(time) / 365.25) > 0.5 then 'spring' else 'other' end as "group", {CSQL} from v_pred group by 1""")
def _(t):
    s, _c = X.season("time")
    return _show(D.contrast(t.pred.withColumn("group", F.when(s > 0.5, "spring").otherwise("other")), "group", "y", "p", "turb"))


@query("dia_regulated", f"""with j as (select * from v_pred left join (select site, dam_storage from v_sites) using (site)), q as (select quantile_cont(dam_storage, 0.75) as h, quantile_cont(dam_storage, 0.25) as l from j)
    select case when dam_storage >= h then 'regulated' else 'unregulated' end as "group", {CSQL} from j, q where dam_storage >= h or dam_storage < l group by 1""")
def _(t):
    d = t.pred.join(t.sites.select("site", "dam_storage"), "site", "left")
    return _show(D.contrast(D.quartile_contrast(d, "dam_storage", "regulated", "unregulated"), "group", "y", "p", "turb"))


@query("dia_external", f"""with g as (select *, unnest(['all', case when turb < 400 then 'below_400' else 'above_400' end, case when turb < 400 then 'org:' || priority end]) as scope from v_pred)
    select scope, {PSQL} from g where scope is not null group by scope""")
def _(t):
    low = F.col("turb") < 400
    dims = {"a": F.lit("all"), "b": F.when(low, "below_400").otherwise("above_400"), "c": F.when(low, F.concat(F.lit("org:"), F.col("priority")))}
    d = D.long_groups(t.pred, dims, ["y", "p"]).withColumnRenamed("group", "scope")
    return D.pack(d, ["scope"], "y", "p").select("scope", "n", *rsel(*PC))


SK = {"v_skill": f"select site, count(*) as n, {R2()} as r2 from v_pred group by site"}


def skill(t):
    return M.site_skill(t.pred, ["site"], "y", "p", ["n", "r2"])


@query("dia_site_picks", """select pick, site, R(r2) as r2 from (select pick, site, r2, row_number() over (partition by pick order by abs(r2 - q), r2, site) as i from v_skill,
    (select unnest(['poor', 'moderate', 'good']) as pick, unnest(quantile_cont(r2, [0.15, 0.5, 0.9])) as q from v_skill)) where i = 1""", SK)
def _(t):
    return D.site_picks(skill(t), "site", "r2", {"poor": 0.15, "moderate": 0.5, "good": 0.9}).select("pick", "site", *rsel("r2"))


@query("dia_rating_picks", """with o as (select site, r2, row_number() over (order by r2 desc, site) as rn, count(*) over () as m, greatest(count(*) over () // 3, 1) as k from v_skill where n >= 5)
    select site, R(r2) as r2, rn, case when rn <= k then 'top' when rn > m - k then 'bottom' else 'middle' end as third from o where rn in (1, k, k + 1, m - k, m - k + 1, m)""", SK)
def _(t):
    return D.third_picks(skill(t), "site", "r2", "n").select("site", *rsel("r2"), "rn", "third")


@query("dia_funnel", """with c as (select (select count(distinct site) from v_base) as a, (select count(*) from (select site from v_lab group by site having count(*) >= 12)) as b,
      (select count(distinct site) from v_lab where value > 200 and site in (select site from v_lab group by site having count(*) >= 12)) as c)
    select 0 as step, 'discovered' as stage, a as n_sites, 0 as lost from c union all select 1, 'qualified', b, a - b from c union all select 2, 'paired', c, b - c from c""")
def _(t):
    q = t.lab.groupBy("site").agg(F.count("*").alias("n")).where("n >= 12")
    paired = t.lab.where("value > 200").join(q, "site", "left_semi")
    return D.funnel({"discovered": t.base, "qualified": q, "paired": paired}, "site")


ATT = {"s_turb": "turbidity_instant", "s_flow": "discharge_instant", "s_dry": "days_since_rain", "s_rain": "precip_30d"}
AV = {"v_att": """select site, method, turb, unnest(['turbidity_instant', 'discharge_instant', 'days_since_rain', 'precip_30d']) as feature,
        unnest([abs((turb - y) / 100), abs((flow - 260) / 500), abs((dry_days - 48) / 97), abs((rain_mm - 41) / 70)]) as a from v_pred"""}


def attr(t):
    return t.pred.select("site", "method", "turb", ((F.col("turb") - F.col("y")) / 100).alias("s_turb"), ((F.col("flow") - 260) / 500).alias("s_flow"),
                         ((F.col("dry_days") - 48) / 97).alias("s_dry"), ((F.col("rain_mm") - 41) / 70).alias("s_rain"))


@query("dia_importance", """select feature, R(avg(a)) as mean_abs, case when feature in ('turbidity_instant', 'discharge_instant') then 'sensor' else 'weather' end as category from v_att
    group by feature""", AV)
def _(t):
    return D.importance(attr(t), ATT).select("feature", *rsel("mean_abs"), "category")


REG = "case when turb < 10 then '<10' when turb < 50 then '10-50' when turb < 200 then '50-200' when turb < 1000 then '200-1000' else '>1000' end"


@query("dia_importance_regime", f"""select regime, feature, n, R(m) as mean_abs, R(m / max(m) over (partition by feature)) as share from (select {REG} as regime, feature, count(*) as n, avg(a) as m from v_att group by 1, 2 having count(*) >= 5)""", AV)
def _(t):
    d = attr(t).withColumn("regime", X.bin_left("turb", [0, 10, 50, 200, 1000], ["<10", "10-50", "50-200", "200-1000", ">1000"]))
    return D.importance_by(d, ATT, "regime", 5, scaled=True).select("regime", "feature", "n", *rsel("mean_abs", "share"))


@query("dia_importance_group", """select 'method' as scope, method as grp, feature, R(avg(a)) as mean_abs from v_att group by method, feature having count(*) >= 20
    union all select 'site', cast(site as varchar), feature, R(avg(a)) from v_att group by site, feature
    union all select 'failing', 'ALL', feature, R(avg(m)) from (select site, feature, avg(a) as m from v_att group by 1, 2) join v_skill using (site) where r2 < 0.72 group by feature""", {**AV, **SK})
def _(t):
    a = attr(t)
    m = D.importance_by(a, ATT, "method", 20).select(F.lit("method").alias("scope"), F.col("method").alias("grp"), "feature", "mean_abs")
    s = D.importance_by(a, ATT, "site", 1)
    bad = skill(t).where("r2 < 0.72").select("site")
    f = s.join(bad, "site", "left_semi").groupBy("feature").agg(F.avg("mean_abs").alias("mean_abs")).select(F.lit("failing").alias("scope"), F.lit("ALL").alias("grp"), "feature", "mean_abs")
    s = s.select(F.lit("site").alias("scope"), F.col("site").cast("string").alias("grp"), "feature", "mean_abs")
    return m.unionByName(s).unionByName(f).select("scope", "grp", "feature", *rsel("mean_abs"))


APP = {"v_feat": "select site, cast(nation as varchar) as nation, cast(geol as varchar) as geol, area, cast(clay_pct as double) as clay, dam_storage, DRAW('role', site) % 5 <> 0 as train from v_sites",
       "v_cat": """select f.*, coalesce(n1, 0) as nn, coalesce(n2, 0) as ng from v_feat f left join (select nation, count(*) as n1 from v_feat where train group by 1) using (nation)
         left join (select geol, count(*) as n2 from v_feat where train group by 1) using (geol)""",
       "v_rng": "select " + ", ".join(f"min({x}) - 0.1 * (max({x}) - min({x})) as l_{x}, max({x}) + 0.1 * (max({x}) - min({x})) as h_{x}" for x in ("area", "clay", "dam_storage")) + " from v_feat where train",
       "v_corr": "select site, count(*) as n_pairs, covar_pop(turb, y) / nullif(stddev_pop(turb) * stddev_pop(y), 0) as corr from v_pred group by site",
       "v_sub": """select site, case when nn > 0 and ng > 0 then 1.0 else 0.0 end::double as cc, least(least(nn / 5.0::double, 1), least(ng / 5.0::double, 1)) as rd, nn, ng,
         ((area between l_area and h_area)::int + (clay between l_clay and h_clay)::int + (dam_storage between l_dam_storage and h_dam_storage)::int) / 3.0::double as fr,
         case when n_pairs < 10 then 0.5 else least(greatest(corr / 0.5, 0), 1) end as cs, corr from v_cat cross join v_rng left join v_corr using (site)""",
       "v_score2": "select *, least(cc, rd, fr, coalesce(cs, 1)) as score from v_sub"}
CATS, NUMS = ["nation", "geol"], ["area", "clay", "dam_storage"]


def feats(t):
    return t.sites.select("site", F.col("nation").cast("string").alias("nation"), F.col("geol").cast("string").alias("geol"), "area", F.col("clay_pct").cast("double").alias("clay"),
                          "dam_storage", (draw(F.lit("role"), "site") % 5 != 0).alias("train"))


@query("app_categorical", "select site, cc as categorical_coverage from v_sub", APP)
def _(t):
    f = feats(t)
    d = D.category_counts(f, f.where("train"), "site", CATS)
    return d.select("site", D.categorical_score(CATS).alias("categorical_coverage"))


@query("app_regime", "select site, R(rd) as regime_density, nn as n_nation, ng as n_geol from v_sub", APP)
def _(t):
    f = feats(t)
    d = D.category_counts(f, f.where("train"), "site", CATS)
    return d.select("site", r(D.regime_score(CATS)).alias("regime_density"), "n_nation", "n_geol")


@query("app_ranges", "select site, R(fr) as feature_ranges from v_sub", APP)
def _(t):
    from freshet.functions.basics import with_scalar

    f = feats(t)
    return with_scalar(f, D.range_bounds(f.where("train"), NUMS)).select("site", r(D.range_score(NUMS)).alias("feature_ranges"))


@query("app_correlation", "select site, n_pairs, R(corr) as corr, R(cs) as corr_score from v_sub join (select site, n_pairs from v_corr) using (site)", APP)
def _(t):
    return D.correlation_score(t.pred, "site", "turb", "y").select("site", "n_pairs", *rsel("corr", "corr_score"))


@query("app_score", """select site, cc as categorical_coverage, R(rd) as regime_density, R(fr) as feature_ranges, R(cs) as corr_score, R(score) as score,
    case when score >= 0.7 then 'high' when score >= 0.4 then 'moderate' when score >= 0.1 then 'low' else 'not_applicable' end as tier,
    array_to_string(list_filter([case when nn = 0 then 'unknown nation' end, case when ng = 0 then 'unknown geol' end, case when nn < 3 then 'sparse nation' end, case when ng < 3 then 'sparse geol' end,
      case when fr < 1 then 'out of range' end, case when corr < 0.3 then 'low correlation' end], lambda x: x is not null), '; ') as warnings from v_score2""", APP)
def _(t):
    f = feats(t)
    d = D.applicability(f, f.where("train"), "site", CATS, NUMS, D.correlation_score(t.pred, "site", "turb", "y"))
    return d.select("site", "categorical_coverage", *rsel("regime_density", "feature_ranges", "corr_score", "score"), "tier", "warnings")
