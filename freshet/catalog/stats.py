"""Rank tests and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.joins import rsel
from freshet.catalog.metrics import AVGRANK, R2
from freshet.catalog.registry import query
from freshet.functions.special import ERFC
from freshet.operators import metrics as M, stats as S


def erfc_sql(x: str) -> str:
    """The published approximation of the complementary error function, in SQL."""
    t, poly = f"(1 / (1 + 0.5 * abs({x})))", repr(ERFC[-1])
    for k in ERFC[-2::-1]:
        poly = f"({poly} * {t} + {k!r})"
    y = f"{t} * exp(-({x}) * ({x}) + {poly})"
    return f"(case when ({x}) >= 0 then {y} else 2 - {y} end)"


def two_sided(z: str) -> str:
    return erfc_sql(f"(abs({z}) / sqrt(2.0))")


SV = {"v_sk": f"select site, {R2()} as r2, {R2('y', 'turb')} as r2b, sqrt(avg((y - p) * (y - p))) as rmse, sqrt(avg((y - turb) * (y - turb))) as rmseb from v_pred group by site",
      "v_sa": "select s.*, area, cast(clay_pct as double) as clay_pct, cast(sand_pct as double) as sand_pct, dam_storage, region, cast(n_dams as double) as n_dams, cast(geol as varchar) as geol from v_sk s join v_sites using (site)"}
ATTRS = ["area", "clay_pct", "sand_pct", "dam_storage"]


def skills(t):
    a = M.site_skill(t.pred, ["site"], "y", "p", ["r2", "rmse"])
    b = M.site_skill(t.pred, ["site"], "y", "turb", ["r2", "rmse"])
    return a, b


def attrs(t):
    return skills(t)[0].join(t.sites.withColumn("geol", F.col("geol").cast("string")), "site")


@query("st_spearman", f"select attribute, n, R(rho) as rho, R({two_sided('(rho * sqrt(n - 1))')}) as p_value from (" + " union all ".join(
    f"select '{a}' as attribute, count(*) as n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as rho from (select {AVGRANK(a)} as x, {AVGRANK('r2')} as y from v_sa)" for a in ATTRS) + ")", SV)
def _(t):
    return S.attribute_correlations(attrs(t), ATTRS, "r2").select("attribute", "n", *rsel("rho", "p_value"))


def _wil(m, a, b):
    return f"""select '{m}' as metric, count(*) filter (d <> 0) as n, least(sum(rk) filter (d > 0), sum(rk) filter (d < 0)) as w, avg(d) as md, quantile_cont(d, 0.5) as med, count(*) as ns
      from (select d, case when d <> 0 then {AVGRANK('abs(d)', 'd = 0')} end as rk from (select {b} - {a} as d from v_sk))"""


@query("st_wilcoxon", f"""select metric, n, ns as n_shared, R(w, 1) as w, R((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)) as z, R(abs((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)) / sqrt(n)) as effect,
    R({two_sided('((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0))')}) as p_value, R(md) as mean_diff, R(med) as median_diff from ({_wil('r2', 'r2', 'r2b')} union all {_wil('rmse', 'rmse', 'rmseb')})""", SV)
def _(t):
    a, b = skills(t)
    d = S.wilcoxon(a, b, "site", ["r2", "rmse"])
    return d.select("metric", "n", "n_shared", *rsel("w", d=1), *rsel("z", "effect", "p_value", "mean_diff", "median_diff"))


KR = {**SV, "v_fr": "select geol, round(r2, 2) as v from v_sa where geol in (select geol from v_sa group by geol having count(*) >= 5)",
      "v_rk": f"select geol, {AVGRANK('v')} as rk, count(*) over (partition by v) as t, count(*) over () as n from v_fr"}


@query("st_kruskal", f"""select n, k, R(h) as h, R(0.5 * {erfc_sql('((cbrt(h / (k - 1)) - (1 - 2.0 / (9 * (k - 1)))) / sqrt(2.0 / (9 * (k - 1))) / sqrt(2.0))')}) as p_value from (
    select cast(sum(c) as bigint) as n, count(*) as k, (12.0::double / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1)) / (1 - sum(tie) / (any_value(n)::double * any_value(n) * any_value(n) - any_value(n))) as h
    from (select geol, sum(rk) as s, count(*) as c, sum(t::double * t - 1) as tie, any_value(n) as n from v_rk group by geol))""", KR)
def _(t):
    d = attrs(t).withColumn("v", F.round("r2", 2))
    return S.kruskal(d, "geol", "v").select("n", "k", *rsel("h", "p_value"))


@query("st_onehot_rho", f"""with b as (select cat, v, case when geol = cat then 1 else 0 end as x from (select geol, round(r2, 2) as v from v_sa), (select geol as cat from v_sa group by geol having count(*) >= 5)),
    k as (select cat, x, v, {AVGRANK('x', 'cat')} as rx, {AVGRANK('v', 'cat')} as ry from b)
    select geol, n, R(rho) as rho, R({two_sided('(rho * sqrt(m - 1))')}) as p_value, R(median) as median from (
      select cat as geol, cast(sum(x) as bigint) as n, count(*) as m, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) as rho, quantile_cont(v, 0.5) filter (x = 1) as median from k group by cat)""", SV)
def _(t):
    d = attrs(t).withColumn("v", F.round("r2", 2))
    return S.indicator_rho(d, "geol", "v").select("geol", "n", *rsel("rho", "p_value", "median"))


@query("st_group_stats", "select geol, count(*) as n, R(avg(r2)) as mean, R(stddev_samp(r2)) as std, R(quantile_cont(r2, 0.5)) as median from v_sa group by geol having count(*) >= 5", SV)
def _(t):
    return S.group_stats(attrs(t), "geol", "r2").select("geol", "n", *rsel("mean", "std", "median"))
