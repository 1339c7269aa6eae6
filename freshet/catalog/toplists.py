"""Sorting and top lists."""

from __future__ import annotations

from freshet.catalog.joins import rsel
from freshet.catalog.metrics import R2
from freshet.catalog.regression import CC, CMP, usgs_compare
from freshet.catalog.registry import query
from freshet.operators import metrics as M, toplists as T


@query("top_n", f"""with s as (select site, {R2()} as r2 from v_pred group by site) select 'best' as kind, site, R(r2) as r2 from (select * from s order by r2 desc, site limit 10)
    union all select 'worst', site, R(r2) from (select * from s order by r2, site limit 10)""")
def _(t):
    s = M.site_skill(t.pred, ["site"], "y", "p", ["r2"])
    return T.extremes(s, "r2", "site", 10).select("kind", "site", *rsel("r2"))


@query("top_sites_by_count", """select oid, site, y from v_pred where site in (select site from v_pred group by site order by count(*) desc, site limit 5)""")
def _(t):
    return T.rows_of_largest(t.pred, "site", 5).select("oid", "site", "y")


WIN = """select site, quantile_cont(ours_r2, 0.5) - quantile_cont(usgs_r2, 0.5) as adv from v_ct group by site"""


@query("top_winners", f"""select 'curve' as winner, site, R(adv) as r2_advantage from (select * from ({WIN}) where adv < -0.01 order by adv, site limit 15)
    union all select 'model', site, R(adv) from (select * from ({WIN}) where adv > 0.01 order by adv desc, site limit 15)""", CMP)
def _(t):
    from freshet.functions.basics import settle

    c = settle(usgs_compare(t).select("site", *CC, "r2_advantage"))  # read once per list
    return T.winners(c, "site", "r2_advantage", 0.01, 15).select("winner", "site", *rsel("r2_advantage"))


@query("sort_total", "select oid, site, time from v_pred order by site, time, oid")
def _(t):
    return t.pred.select("oid", "site", "time").orderBy("site", "time", "oid")
