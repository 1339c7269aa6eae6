"""Splits, sampling and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from freshet.catalog.joins import rsel
from freshet.catalog.metrics import BOOT, R2
from freshet.catalog.registry import query
from freshet.functions.basics import r, ratio, with_scalar
from freshet.operators import metrics as M, sampling as S, trials as T
from freshet.operators.blocks import medians

PROF = {"v_prof": """select s.site, s.region, s.nation, n, n_big, std, med, method from v_sites s join (select site, count(*) as n, count(*) filter (y > 480) as n_big,
      stddev_samp(y) as std, quantile_cont(y, 0.5) as med from v_pred group by site) p using (site)
    join (select site, method from (select site, method, count(*) as c from v_pred group by 1, 2) qualify row_number() over (partition by site order by c desc, method) = 1) using (site)"""}


def profile(t):
    from freshet.operators.blocks import modal

    a = t.pred.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("y") > 480).alias("n_big"), F.stddev_samp("y").alias("std"))
    d = a.join(medians(t.pred, ["site"], med="y"), "site").join(modal(t.pred, ["site"], "method", "method"), "site")
    return t.sites.select("site", "region", "nation").join(d, "site")


@query("smp_stratified_holdout", """select site, nation, case when n < 95 then 'holdout' when rn <= least(greatest(floor(m * 0.2::double), 2), m - 1) then 'holdout' else 'training' end as role
    from (select *, row_number() over (partition by nation, n >= 95 order by DRAW('42', site), site) as rn, count(*) over (partition by nation, n >= 95) as m from v_prof)""", PROF)
def _(t):
    return S.stratified_holdout(profile(t), "site", "nation", "n", 42, min_n=95).select("site", "nation", "role")


@query("smp_extreme_split", """with v as (select site from v_prof where n_big >= 2 order by n_big desc, site limit 2),
    rest as (select * from v_prof where site not in (select site from v)),
    h as (select site from (select site, nation, row_number() over (order by nation) as i from rest qualify row_number() over (partition by nation order by n desc, site) = 1)
      qualify row_number() over (order by nation) <= greatest(1, round((select count(*) from rest) * 0.25)))
    select site, case when site in (select site from v) then 'vault' when site in (select site from h) then 'holdout' else 'training' end as role from v_prof""", PROF)
def _(t):
    return S.extreme_split(profile(t), "site", "nation", "n", "n_big").select("site", "role")


@query("smp_gkf5", """select site, R(med) as med, cast((row_number() over (order by med desc, site) - 1) % 5 as int) as fold
    from (select site, quantile_cont(y, 0.5) as med from v_pred group by site)""")
def _(t):
    return S.balanced_folds(t.pred, "site", "y").select("site", *rsel("med"), "fold")


@query("smp_logo", """select site as fold, count(*) as n_test, (select count(*) from v_pred) - count(*) as n_train,
    R(((select sum(y) from v_pred) - sum(y)) / ((select count(*) from v_pred) - count(*))) as train_mean from v_pred group by site""")
def _(t):
    # a fold is the total minus its site, so training rows are never copied per fold
    own = t.pred.groupBy(F.col("site").alias("fold")).agg(F.count("*").alias("n_test"), F.sum("y").alias("_s"))
    d = with_scalar(own, own.agg(F.sum("n_test").alias("_n"), F.sum("_s").alias("_t")))
    n_train = F.col("_n") - F.col("n_test")
    return d.select("fold", "n_test", n_train.alias("n_train"), r(ratio(F.col("_t") - F.col("_s"), n_train)).alias("train_mean"))


@query("smp_group_shuffle", """select oid, rn <= floor(m * 0.85::double) as is_train from v_pred join (select site, row_number() over (order by DRAW('42', site), site) as rn,
    count(*) over () as m from (select distinct site from v_pred)) using (site)""")
def _(t):
    return S.group_shuffle(t.pred.select("oid", "site"), "site", 42).select("oid", "is_train")


@query("smp_temporal", """select oid, row_number() over (partition by site order by time, oid) <= floor(count(*) over (partition by site) * 0.7::double) as is_train from v_pred""")
def _(t):
    return S.temporal_split(t.pred.select("oid", "site", "time"), "site", "time", "oid").select("oid", "is_train")


def CAL(sizes: list[int] = T.SIZES, trials: int = T.TRIALS, modes=tuple(T.MODES)) -> dict[str, str]:
    """SQL views: v_cal (mode, n, trial, site, oid) and v_test with the rows left to score."""
    sz = "[" + ", ".join(str(x) for x in sizes if x) + "]"
    cal = {
        "random": "select 'random' as mode, n, trial, site, oid from v_rnd, v_size where rk <= n and n < ns",
        "temporal": "select 'temporal' as mode, n, 1 as trial, site, oid from v_ord, v_size where rn <= n and n < ns",
        "temporal_block": "select 'temporal_block' as mode, n, trial, b.site, oid from v_blk b join v_ord o on b.site = o.site and rn between s + 1 and s + n",
        "seasonal": "select 'seasonal' as mode, n, trial, site, oid from v_srk, v_size where rk <= n and n < ns",
    }
    test = {
        "random": "select 'random' as mode, n, trial, site, oid from v_rnd, v_size where rk > n",
        "temporal": "select 'temporal' as mode, n, 1 as trial, site, oid from v_ord, v_size where rn > n",
        "temporal_block": "select 'temporal_block' as mode, n, trial, b.site, oid from v_blk b join v_ord o on b.site = o.site where not rn between s + 1 and s + n",
        "seasonal": f"""select 'seasonal' as mode, n, trial, site, oid from v_srk, v_size where rk > n and not ok
            union all select 'seasonal', n, trial, site, oid from v_sea join v_seaok using (site) join v_cnt using (site), v_size, (select unnest(range(1, {trials} + 1)) as trial) where ok and not ins and n < ns""",
    }
    zero = [f"select unnest({list(modes)!r}) as mode, 0 as n, 1 as trial, site, oid from v_pred"] if 0 in sizes else []
    return {
        "v_cnt": "select site, count(*) as ns from v_pred group by site",
        "v_ord": "select site, oid, month(time) as mon, row_number() over (partition by site order by time, oid) as rn, count(*) over (partition by site) as ns from v_pred",
        "v_tr": f"select site, oid, ns, unnest(range(1, {trials} + 1)) as trial from v_pred join v_cnt using (site)",
        "v_rnd": "select site, oid, trial, ns, row_number() over (partition by site, trial order by DRAW('7', 'random', oid, trial), oid) as rk from v_tr",
        "v_peak": """select site, mon as pk from (select site, mon, count(*) as c, min(rn) as f from v_ord group by 1, 2)
            qualify row_number() over (partition by site order by c desc, f) = 1""",
        "v_sea": """select site, oid, mon in ((pk + 10) % 12 + 1, pk, pk % 12 + 1) as ins from v_ord join v_peak using (site)""",
        "v_seaok": "select site, count(*) filter (not ins) >= 2 as ok from v_sea group by site",
        "v_srk": """select site, oid, trial, ns, ok, row_number() over (partition by site, trial order by DRAW('7', 'seasonal', oid, trial), oid) as rk
            from v_tr join v_sea using (site, oid) join v_seaok using (site) where ins or not ok""",
        "v_size": f"select unnest({sz}) as n",
        "v_blk": f"""select site, n, trial, DRAW('7', 'temporal_block', site, n, trial) % (ns - n + 1) as s from (select site, ns, n, unnest(range(1, {trials} + 1)) as trial from v_cnt, v_size where n < ns)
            where trial <= greatest(ns - n, 1)""",
        "v_cal": " union all ".join(cal[m] for m in modes),
        "v_test": " union all ".join([*(test[m] for m in modes), *zero]),
    }


def lines(t):
    return t.pred.select("site", "oid", "time", F.col("turb").alias("x"), "y", F.log1p("p").alias("p"), F.log1p("y").alias("t"))


def sets(t, sizes=T.SIZES, trials=T.TRIALS, modes=T.MODES):
    return T.calibration_sets(lines(t), "site", "oid", "time", ["x", "y", "p", "t"], sizes, trials, list(modes), 7)


@query("smp_calibration", "select mode, n, trial, site, count(*) as n_cal, cast(sum(oid) as bigint) as oid_sum, min(oid) as oid_min, max(oid) as oid_max, R(avg(y)) as mean_y from v_cal join v_pred using (site, oid) group by mode, n, trial, site", CAL())
def _(t):
    return sets(t).where("n > 0").selectExpr(
        "mode", "n", "trial", "site", "cast(size(cal) as bigint) as n_cal", "aggregate(cal.u, 0L, (a, x) -> a + x) as oid_sum", "array_min(cal.u) as oid_min",
        "array_max(cal.u) as oid_max", "aggregate(cal.y, 0D, (a, x) -> a + x) / size(cal) as mean_y").withColumn("mean_y", r("mean_y"))


@query("smp_trials", """select c.mode, c.n, c.trial, c.site, coalesce(n_cal, 0) as n_cal, n_test, R(test_mean) as test_mean from (select mode, n, trial, site, count(*) as n_test, avg(y) as test_mean from v_test join v_pred using (site, oid) group by all) c
    left join (select mode, n, trial, site, count(*) as n_cal from v_cal group by all) d on c.mode = d.mode and c.n = d.n and c.trial = d.trial and c.site = d.site""", CAL())
def _(t):
    parts = T.calibration_parts(lines(t), "site", "oid", "time", ["y"], T.SIZES, T.TRIALS, T.MODES, 7)
    d = reduce(lambda a, b: a.unionByName(b), [T.split_sizes(rows, sets, "site", "oid", "time", "y") for rows, sets in parts]).where("n_test > 0")
    return d.select("mode", "n", "trial", "site", "n_cal", "n_test", r("test_mean").alias("test_mean"))


SUF = {**{k: v for k, v in BOOT.items() if k in ("v_num", "v_r2", "v_draws")},
       "v_r2": f"""select site, {R2()} as r2, count(*) as c, sum(y) as sy, sum(p) as sp, sum(y * y) as syy, sum(p * p) as spp, sum(y * p) as syp,
         sum(ln(y)) as l1, sum(ln(y) * ln(y)) as l2, sum(pow(ln(y) - ln(p), 2)) as lse, avg(abs(y - p) / y * 100) as mape,
         corr(ry, rp) as rho from (select *, rank() over (partition by site order by y) + (count(*) over (partition by site, y) - 1) / 2.0 as ry,
         rank() over (partition by site order by p) + (count(*) over (partition by site, p) - 1) / 2.0 as rp from v_pred) group by site""",
       "v_num": "select *, row_number() over (order by DRAW('42', site), site) as idx, count(*) over () as n_all from v_r2",
       "v_pick": "select d.rep, v.* from v_draws d join v_num v on d.pick = v.idx",
       "v_uni": "select distinct rep, site, r2, mape, rho, c from v_pick",
       "v_boot": """select rep, 1 - (sum(syy) - 2 * sum(syp) + sum(spp)) / (sum(syy) - sum(sy) * sum(sy) / sum(c)) as nse,
          1 - sum(lse) / (sum(l2) - sum(l1) * sum(l1) / sum(c)) as log_nse,
          1 - sqrt(pow((sum(syp) - sum(sy) * sum(sp) / sum(c)) / sqrt((sum(syy) - sum(sy) * sum(sy) / sum(c)) * (sum(spp) - sum(sp) * sum(sp) / sum(c))) - 1, 2)
            + pow(sqrt((sum(spp) - sum(sp) * sum(sp) / sum(c)) / (sum(syy) - sum(sy) * sum(sy) / sum(c))) - 1, 2) + pow(sum(sp) / sum(sy) - 1, 2)) as kge from v_pick group by rep""",
       "v_bmed": """select rep, quantile_cont(r2, 0.5) as med_r2, quantile_cont(mape, 0.5) as med_mape, quantile_cont(rho, 0.5) as med_rho, sum(r2 * c) / sum(c) as mean_r2, avg(case when r2 > 0 then 1.0 else 0.0 end) as frac_gt0,
          avg(case when r2 > 0.8 then 1.0 else 0.0 end) as frac_hi from v_uni group by rep"""}
BOOTC = ["nse", "log_nse", "kge", "med_r2", "med_mape", "med_rho", "mean_r2", "frac_gt0", "frac_hi"]


@query("smp_bootstrap_sites", "select " + ", ".join(f"R(quantile_cont({c}, 0.025)) as {c}_lo, R(quantile_cont({c}, 0.975)) as {c}_hi" for c in BOOTC)
       + " from v_boot join v_bmed using (rep)", SUF)
def _(t):
    from freshet.operators.bootstrap import site_bootstrap

    d = site_bootstrap(t.pred, "site", "y", "p", 42, 1000, hi=0.8)
    return S.interval(d, BOOTC).select(*rsel(*[f"{c}_{e}" for c in BOOTC for e in ("lo", "hi")]))


CURVE = {**BOOT, "v_grp": f"select site, priority, {R2()} as r2 from v_pred group by 1, 2",
         "v_uniq": "select distinct rep, site from v_draws join (select idx, site from v_num) on pick = idx"}


@query("smp_bootstrap_curve", """select priority, R(quantile_cont(m, 0.025)) as lo, R(quantile_cont(m, 0.975)) as hi from (select rep, priority, quantile_cont(r2, 0.5) as m
    from v_uniq join v_grp using (site) group by 1, 2) group by priority""", CURVE)
def _(t):
    from freshet.operators.bootstrap import median_by_group

    g = M.site_skill(t.pred, ["site", "priority"], "y", "p", ["r2"])
    return median_by_group(g, "site", ["priority"], "r2", 42, 1000).select("priority", *rsel("lo", "hi"))


@query("smp_bootstrap_median", """select R((select quantile_cont(r2, 0.5) from v_r2)) as median, R(quantile_cont(m, 0.025)) as median_lo, R(quantile_cont(m, 0.975)) as median_hi
    from (select rep, quantile_cont(r2, 0.5) as m from v_draws join (select idx, r2 from v_num) on pick = idx group by rep)""", BOOT)
def _(t):
    s = M.site_skill(t.pred, ["site"], "y", "p", ["r2"])
    return S.bootstrap_median(s, "site", "r2", 42, 1000).select(*rsel("median", "median_lo", "median_hi"))


@query("smp_random_subset", """select 'random' as kind, seed, site from (select site, unnest([200, 201, 202]) as seed from (select distinct site from v_pred))
      qualify row_number() over (partition by seed order by DRAW(seed, site), site) <= 40
    union all select 'proportional', seed, site from (select * from (select site, nation, seed, row_number() over (partition by seed, nation order by DRAW(seed, site), site) as rn,
        count(*) over (partition by seed, nation) as m, (select count(*) from v_sites) as al from (select site, nation, unnest([200, 201, 202]) as seed from v_sites))
      where rn <= least(greatest(1, round(m * 40.0::double / al)), m)) qualify row_number() over (partition by seed order by DRAW('trim', seed, site), site) <= 40""")
def _(t):
    a = S.random_subsets(t.pred.select("site").distinct(), "site", [200, 201, 202], 40).select(F.lit("random").alias("kind"), "seed", "site")
    b = S.proportional_subsets(t.sites, "site", "nation", [200, 201, 202], 40).select(F.lit("proportional").alias("kind"), "seed", "site")
    return a.unionByName(b)


@query("smp_stratified_sites", """with q as (select quantile_cont(std, 1/3::double) as a, quantile_cont(std, 2/3::double) as b, quantile_cont(med, 1/3::double) as c, quantile_cont(med, 2/3::double) as d, count(*) as al from v_prof),
    s as (select site, case when std <= a then 'low' when std <= b then 'mid' else 'high' end || '/' || case when med <= c then 'low' when med <= d then 'mid' else 'high' end || '/' || method as stratum, al from v_prof, q),
    n as (select *, row_number() over (partition by stratum order by DRAW('5', site), site) as rn, count(*) over (partition by stratum) as m from s)
    select site, stratum from n where rn <= least(greatest(1, round(m * 50.0::double / al)), m) order by DRAW('5', 'trim', site), site limit 50""", PROF)
def _(t):
    return S.stratified_sites(profile(t), "site", "std", "med", "method", 50, 5)


@query("smp_cover_sites", """with c as (select distinct s from (select min(site) as s from v_pred group by method union all select min(site) from v_pred group by family union all select min(site) from v_pred group by priority))
    select s as site, 'cover' as reason from c union all select * from (select distinct site, 'pad' from v_pred where site not in (select s from c) order by site
      limit (select 12 - count(*) from c))""")
def _(t):
    return S.covering_sites(t.pred, "site", ["method", "family", "priority"], 12)
