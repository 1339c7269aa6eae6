"""Cross-site models."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.joins import rsel
from freshet.catalog.metrics import KGE, R2
from freshet.catalog.registry import query
from freshet.functions.basics import r, settle
from freshet.operators import metrics as M, sampling as S
from freshet.operators.blocks import medians
from freshet.plans import models as P

FEATS = ["turb", "flow", "method", "family", "log_drainage_area", "huc2", "clay_pct"]
CATS = ["method", "family", "huc2"]
ROLE = "case when site % 5 = 0 then 'holdout' when site % 7 = 0 then 'vault' else 'training' end"


def attrs(t):
    basic = t.sites.select("site", F.col("area").alias("drainage_area_km2"), F.lpad(F.col("nation").cast("string"), 2, "0").alias("huc2"))
    return basic, t.sites.select("site", "clay_pct")


def prepared(t):
    basic, shed = attrs(t)
    split = t.sites.select("site", F.expr(ROLE).alias("role"))
    p = t.pred.select("site", "oid", "time", "y", "turb", "flow", "method", F.nullif("family", F.lit("unknown")).alias("family"))
    return P.prepare(p, split, basic, shed, FEATS, CATS, "boxcox", 0.2)


@query("ml_select", "select oid, turb, coalesce(nullif(family, 'unknown'), 'missing') as family, method from v_pred")
def _(t):
    d = t.pred.withColumn("family", F.nullif("family", F.lit("unknown")))
    names = P.choose(["turb", "flow", "family", "method", "rain_mm"], keep=["turb", "family", "method", "rain_mm"], drop=["rain_mm"])
    return P.select_features(d, names, ["family", "method"], ["oid"])


@query("ml_prepare", f"""select site, time, y, R((pow(1 + y, 0.2) - 1) / 0.2) as target, turb, flow, method, coalesce(nullif(family, 'unknown'), 'missing') as family, R(ln(1 + area)) as log_drainage_area,
    lpad(cast(nation as varchar), 2, '0') as huc2, clay_pct, (select count(*) from v_pred) as n_loaded, (select count(*) from v_pred where site not in (select site from v_sites where {ROLE} <> 'training')) as n_split,
    (select count(*) from v_pred join v_sites using (site) where {ROLE} = 'training') as n_merged, count(*) over () as n_selected
    from (select * from v_pred where {ROLE} = 'training' qualify row_number() over (partition by site, time order by oid) = 1) join v_sites using (site)""")
def _(t):
    """The prepared rows, each with the row counts of the steps."""
    d, lineage = prepared(t)
    counts = {r.stage: r.n_rows for r in lineage.collect()}  # one row a step
    return d.withColumn("target", r("target")).withColumn("log_drainage_area", r("log_drainage_area")).withColumns({f"n_{k}": F.lit(v).cast("long") for k, v in counts.items()})


@query("ml_gbt")
def _(t):
    d, _lineage = prepared(t)
    num = [x for x in FEATS if x not in CATS]
    model, factor = P.train_final(d, P.boosted(num, CATS, "target", maxIter=10, maxDepth=4), "site", "y", "boxcox", 0.2)
    s = settle(P.score(d, model, factor, "y", "boxcox", 0.2, ["site", "time"]))
    return M.site_skill(s, ["site"], "y", "pred_native", ["n", "r2", "rmse", "pbias"])


@query("ml_cv")
def _(t):
    d, _lineage = prepared(t)
    num = [x for x in FEATS if x not in CATS]
    _oof, folds = P.grouped_cv(d, P.boosted(num, CATS, "target", maxIter=5, maxDepth=3), "site", "target", "y", "boxcox", 0.2)
    return folds


@query("ml_meta", """select 'range' as kind, 'turb' as name, null as value, min(turb) as lo, max(turb) as hi, R(quantile_cont(turb, 0.5)) as median, null::bigint as n_sites from v_pred
    union all select 'range', 'y', null, min(y), max(y), R(quantile_cont(y, 0.5)), null from v_pred
    union all select distinct 'category', 'method', method, null, null, null, null from v_pred union all select distinct 'category', 'family', family, null, null, null, null from v_pred
    union all select 'class', 'region', region, null, null, null, count(distinct site) from v_pred join v_sites using (site) group by region""")
def _(t):
    d = t.pred.join(t.sites.select("site", "region"), "site")
    return P.metadata(d, "site", ["turb", "y"], ["method", "family"], ["region"]).withColumn("median", r("median"))


LM = {"v_tr": "select *, ln(1 + turb) as lx, ln(1 + y) as ly, area from v_pred join v_sites using (site)",
      "v_shuf": "select t.*, rn <= floor(m * 0.85::double) as is_train from v_tr t join (select site, row_number() over (order by DRAW('42', site), site) as rn, count(*) over () as m from (select distinct site from v_tr)) using (site)",
      "v_m": """select (d * c - b * e) / (a * c - b * b) as w1, (a * e - b * d) / (a * c - b * b) as w2, mx, mf, my from (select var_pop(lx) as a, covar_pop(lx, area) as b, var_pop(area) as c, covar_pop(lx, ly) as d,
        covar_pop(area, ly) as e, avg(lx) as mx, avg(area) as mf, avg(ly) as my from v_shuf where is_train)""",
      "v_pm": "select s.*, my + w1 * (lx - mx) + w2 * (area - mf) as pm, w1, w2, mx, mf, my from v_shuf s, v_m",
      "v_f": "select least(greatest(quantile_cont(y / greatest(exp(pm) - 1, 1e-6), 0.5), 0.5), 3.0) as factor from v_pm where not is_train"}


def fitted(t):
    d = t.pred.join(t.sites.select("site", "area"), "site").withColumns({"lx": F.log1p("turb"), "ly": F.log1p("y")})
    model, factor = P.train_final(d, P.linear(["lx", "area"], "ly"), "site", "y", "log1p", None)
    return d, model, factor


@query("ml_score", """select oid, y, R(pm) as pred_ms, R(greatest(exp(pm) - 1, 0) * factor, 3) as pred_native, R(abs(y - greatest(exp(pm) - 1, 0) * factor), 3) as abs_error,
    R(abs(y - greatest(exp(pm) - 1, 0) * factor) / y * 100, 3) as pct_error from v_pm, v_f""", LM)
def _(t):
    d, model, factor = fitted(t)
    s = P.score(d, model, factor, "y", "log1p", None, ["oid"])
    return s.select("oid", "y", *rsel("pred_ms"), *rsel("pred_native", "abs_error", "pct_error", d=3))


@query("ml_score_external", """with e as (select s_suppkey, greatest(s_acctbal, 0) / 30 as turb, greatest(s_acctbal, 1) / 25 as y, 25 + (s_suppkey * 6151 % 2400) / 100.0::double + 0.003 as lat, -120 + (s_suppkey * 3571 % 5000) / 100.0::double as lon from supplier),
    n as (select s_suppkey, v.area from (select s_suppkey, v.site, v.area, sqrt(pow(v.lat - e.lat, 2) + pow(v.lon - e.lon, 2)) as d from e, v_sites v) v where d < 2 qualify row_number() over (partition by s_suppkey order by d, site) = 1),
    x as (select e.*, n.area is not null as matched, coalesce(n.area, (select quantile_cont(area, 0.5) from v_tr)) as ar from e left join n using (s_suppkey)),
    p as (select *, my + w1 * (ln(1 + turb) - mx) + w2 * (ar - mf) as pm from x, v_m)
    select s_suppkey, matched, y, R(pm) as pred_ms, R(greatest(exp(pm) - 1, 0) * factor, 3) as pred_native from p, v_f""", LM)
def _(t):
    d, model, factor = fitted(t)
    ext = t.table("supplier").selectExpr("s_suppkey", "log1p(greatest(s_acctbal, 0) / 30) as lx", "greatest(s_acctbal, 1) / 25 as y",
                                         "25 + (s_suppkey * 6151 % 2400) / 100.0D + 0.003D as lat", "-120 + (s_suppkey * 3571 % 5000) / 100.0D as lon")
    s = P.score_external(ext, t.sites, d, model, factor, "s_suppkey", ["area"], 2.0, "log1p", None)
    return s.select("s_suppkey", "matched", "y", *rsel("pred_ms"), *rsel("pred_native", d=3))


AB = {"v_ab": f"select priority as label, {R2()} as r2, {KGE()} as kge, sqrt(avg((y - p) * (y - p))) as rmse from v_pred group by priority"}


@query("ml_ablation_table", """select a.label, R(a.r2) as r2, R(a.kge) as kge, R(a.rmse) as rmse, R(a.r2 - b.r2) as d_r2, R(a.kge - b.kge) as d_kge, R(a.rmse - b.rmse) as d_rmse
    from v_ab a, v_ab b where b.label = '1-URGENT' and a.label <> '1-URGENT' order by d_r2, label""", AB)
def _(t):
    m = M.site_skill(t.pred.withColumnRenamed("priority", "label"), ["label"], "y", "p", ["r2", "kge", "rmse"])
    d = P.ablation(m, "label", "1-URGENT", ["r2", "kge", "rmse"], "r2")
    return d.select("label", *rsel("r2", "kge", "rmse", "d_r2", "d_kge", "d_rmse"))


SEEDS = list(range(200, 210))
SUB = {"v_sk": f"select site, {R2()} as r2 from v_pred group by site",
       "v_mem": f"select seed, site from (select site, unnest({SEEDS}) as seed from (select distinct site from v_pred)) qualify row_number() over (partition by seed order by DRAW(seed, site), site) <= 60",
       "v_run": """select seed, quantile_cont(r2, 0.5) as score from (select s.seed, k.site, r2 from (select distinct seed from v_mem) s, v_sk k
          where not exists (select 1 from v_mem m where m.seed = s.seed and m.site = k.site)) group by seed"""}


def runs(t):
    sk = M.site_skill(t.pred, ["site"], "y", "p", ["r2"])
    mem = settle(S.random_subsets(sk, "site", SEEDS, 60))
    out = sk.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS]))).join(mem, ["seed", "site"], "left_anti")
    return mem, medians(out, ["seed"], score="r2"), sk


@query("ml_subset_effect", """with t as (select count(*) as n, sum(score) as s from v_run), w as (select site, count(*) as k, sum(score) as sw from v_mem join v_run using (seed) group by site)
    select site, coalesce(k, 0) as n_with, n - coalesce(k, 0) as n_without, R(sw / k) as mean_with, R((s - coalesce(sw, 0)) / nullif(n - coalesce(k, 0), 0)) as mean_without,
      R(sw / k - (s - sw) / nullif(n - k, 0), 6) as effect from v_sk left join w using (site), t""", SUB)
def _(t):
    mem, score, sk = runs(t)
    d = P.subset_effect(mem, score, sk, "seed", "site", "score")
    return d.select("site", "n_with", "n_without", *rsel("mean_with", "mean_without"), r("effect", 6).alias("effect"))


@query("ml_anchor", """with r as (select seed, case when score > (select quantile_cont(score, 0.5) from v_run) then 1 else 0 end as won from v_run), w as (select site, count(*) as k, sum(won)::bigint as n_won from v_mem join r using (seed) group by site)
    select site, coalesce(k, 0) as n_runs, coalesce(n_won, 0) as n_won, R(coalesce(n_won, 0) / greatest(coalesce(k, 0), 1)::double) as win_rate,
      R(coalesce(n_won, 0) / greatest(coalesce(k, 0), 1)::double - (select avg(won) from r)) as anchor_score from v_sk left join w using (site)""", SUB)
def _(t):
    mem, score, sk = runs(t)
    return P.anchor_rate(mem, score, sk, "seed", "site", "score").select("site", "n_runs", "n_won", *rsel("win_rate", "anchor_score"))
