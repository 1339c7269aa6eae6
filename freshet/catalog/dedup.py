"""Duplicates, unions, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.operators import dedup as D
from freshet.operators.blocks import keep_first


@query("dedup_conflict", """with g as (select *, count(distinct value) over (partition by site, time) > 1 as conflict,
        count(*) over (partition by site, time) as n_copies from v_lab)
    select site, time, pos, value, org, n_copies, conflict as was_conflict from g
    qualify row_number() over (partition by site, time order by value is null,
      case when conflict and lower(org) like '%usgs%' then 0 else 1 end, pos) = 1""")
def _(t):
    d = t.lab.select("site", "time", "pos", "value", "org")
    return D.resolve_conflicts(d, ["site", "time"], "value", "org", "pos")


@query("dedup_keep_first", """select site, time, pos, value from v_lab
    qualify row_number() over (partition by site, time order by pos) = 1""")
def _(t):
    return keep_first(t.lab.select("site", "time", "pos", "value"), ["site", "time"], ["pos"])


@query("union_tiers", """select event_id as id, site, value, qualifier, 'continuous' as source from v_obs
    union all by name select pos as id, site, value, org, 'discrete' as source from v_lab""")
def _(t):
    return D.stack({
        "continuous": t.obs.select(F.col("event_id").alias("id"), "site", "value", "qualifier"),
        "discrete": t.lab.select(F.col("pos").alias("id"), "site", "value", "org"),
    })


@query("union_common_cols", """select site, time, value, pos from (select site, time, value, pos, 0 as s from v_lab
      union all select site, time, value * 2, event_id, 1 from v_base)
    qualify row_number() over (partition by site, time order by s, pos) = 1""")
def _(t):
    b = t.base.select("site", "time", (F.col("value") * 2).alias("value"), F.col("event_id").alias("pos"), "pcode")
    return D.stack_common(t.lab, b, ["site", "time"], ["pos"])


PAIRS = ("select user_id as site from events where event_type = 'error' and value > 100",
         "select user_id as site from events where event_type = 'click' and value > 100")


def _two(t):
    f = lambda k: t.base.where((F.col("pcode") == k) & (F.col("value") > 100)).select("site")
    return f("error"), f("click")


@query("set_intersect", f"{PAIRS[0]} intersect {PAIRS[1]}")
def _(t):
    a, b = _two(t)
    return a.intersect(b)


@query("set_difference", f"{PAIRS[0]} except {PAIRS[1]}")
def _(t):
    a, b = _two(t)
    return a.distinct().join(b, "site", "left_anti")


@query("set_lost_gained", f"""select coalesce(a.site, b.site) as site, coalesce(na, 0) as n_before, coalesce(nb, 0) as n_after,
      case when nb is null then 'lost' when na is null then 'gained' else 'kept' end as state
    from (select site, count(*) as na from ({PAIRS[0]}) group by 1) a
    full join (select site, count(*) as nb from ({PAIRS[1]}) group by 1) b on a.site = b.site""")
def _(t):
    return D.lost_gained(*_two(t), "site")
