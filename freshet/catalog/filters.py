"""Quality filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.functions import normalize as N
from freshet.functions.basics import r
from freshet.operators import qc

BY = ["site", "pcode"]
APPROVED = "trim(split_part(approval_status, ',', 1)) in ('A', 'Approved')"
CODES = """list_filter(string_split(trim(regexp_replace(upper(coalesce(qualifier, '')), '[\\[\\]''",\\s]+', ' ', 'g')), ' '),
    lambda x: x <> '')"""
BAD = f"""len(list_intersect({CODES}, ['ICE', 'EQUIP', 'EQP', 'BACKWATER', 'BKW', 'MAINT', 'MNT', 'DISCONTINUED',
    'UNAVAIL', 'DRY', 'DEBRIS'])) > 0"""
QC_VIEWS = {
    "v_ok": f"select * from v_obs where {APPROVED}",
    "v_ends": """select site, pcode, code, hrs, time from (
        select site, pcode, code, hrs, time, lead(time) over (partition by site, pcode, code order by time, event_id) as nx
        from v_ok, (values ('ICE', 48), ('MAINT', 4)) c(code, hrs) where upper(qualifier) like '%' || code || '%')
        where nx is null or nx - time > interval 1 hour""",
    "v_marked": f"""select *, case when {BAD} then 'bad_qualifier' when exists (select 1 from v_ends e
          where e.site = o.site and e.pcode = o.pcode and o.time > e.time and o.time <= e.time + to_hours(e.hrs)) then 'buffer'
        when coalesce(value between -0.01 and 100000, false) then 'kept' else 'range' end as stage from v_ok o""",
    "v_clean": "select site, pcode, time, event_id, value from v_marked where stage = 'kept'",
}


@query("qc_approval", f"select event_id, site, value from v_obs where {APPROVED}")
def _(t):
    return qc.approved(t.obs).select("event_id", "site", "value")


@query("qc_qualifier", f"select event_id, site, value from v_obs where not ({BAD})")
def _(t):
    return t.obs.where(~qc.bad_qualifier()).select("event_id", "site", "value")


@query("qc_buffer", "select event_id, stage = 'buffer' as in_buffer from v_marked where stage not in ('bad_qualifier')", QC_VIEWS)
def _(t):
    d = qc.flag_buffer(qc.approved(t.obs), BY, "time", "event_id")
    return d.where(~qc.bad_qualifier()).select("event_id", "in_buffer")


@query("qc_range", "select event_id, value from v_obs where value >= -0.01 and value <= 100000")
def _(t):
    return t.obs.where(qc.in_range()).select("event_id", "value")


@query("qc_stats", """select site, n_original, n_original - coalesce(n, 0) as n_not_approved, coalesce(b, 0) as n_bad_qualifier,
      coalesce(u, 0) as n_buffer_excluded, coalesce(g, 0) as n_range_excluded, coalesce(kk, 0) as n_after_filter,
      round(coalesce(kk, 0) / n_original::double * 100, 1) as pct_retained
    from (select site, count(*) as n_original from v_obs group by site) left join (select site, count(*) as n,
      count(*) filter (stage = 'bad_qualifier') as b, count(*) filter (stage = 'buffer') as u,
      count(*) filter (stage = 'range') as g, count(*) filter (stage = 'kept') as kk from v_marked group by site) using (site)""",
       QC_VIEWS)
def _(t):
    return qc.qc_stats(t.obs, "site", BY, "time", "event_id")


@query("qc_contamination", "select pos, condition from v_labraw where not coalesce(regexp_matches(lower(condition), "
       "'contamination|detected not quantified|present above quantification limit'), false)")
def _(t):
    return t.labraw.where(~N.contaminated("condition")).select("pos", "condition")


@query("qc_censoring", """select pos, site from v_lab where site not in
    (select site from v_lab group by site having avg(cast(is_nondetect as int)) > 0.15)""")
def _(t):
    return qc.drop_sites(t.lab, qc.high_censoring(t.lab, share=0.15)).select("pos", "site")


@query("qc_valid_rows", """select pos, v as value from (select pos, nullif(start_time, '') as s,
    try_cast(measure as double) - 20 as v from v_labraw) where s is not null and v >= 0""")
def _(t):
    d = t.labraw.select("pos", F.nullif("start_time", F.lit("")).alias("s"), (N.number("measure") - 20).alias("value"))
    return d.dropna(subset=["s", "value"]).where("value >= 0").select("pos", "value")


@query("qc_units", """select pos from v_labraw where pos % 5 <> 1 and coalesce(condition, '') <> 'Systematic Contamination'""")
def _(t):
    from freshet.sources.field import routine_readings

    d = t.labraw.selectExpr(
        "pos", "case when pos % 5 = 1 then 'NTU' else 'FNU' end as unit",
        "case when condition = 'Systematic Contamination' then 'Quality Control' else 'Sample-Routine' end as activity")
    return routine_readings(d, "unit", "activity").select("pos")


@query("qc_min_samples", "select pos, site from v_lab qualify count(*) over (partition by site) >= 15")
def _(t):
    return qc.min_samples(t.lab, "site", 15).select("pos", "site")


@query("qc_low_signal", "select event_id, value from v_obs where value > 5")
def _(t):
    return t.obs.where("value > 5").select("event_id", "value")


@query("qc_site_tiers", """with a as (select site, count(y) as n_samples, stddev_samp(y) as std,
        avg(case when status = 'P' then 0.0 else 1.0 end) as src, quantile_cont(y, 0.5) as med from v_pred group by site),
      m as (select site, method from (select site, method, count(*) as c from v_pred group by 1, 2)
        qualify row_number() over (partition by site order by c desc, method) = 1)
    select site, n_samples, R(std) as std, R(src) as src_share, R(med) as median, method as method_mode,
      n_samples >= 50 and method in ('auto_point', 'grab') and std > 100 as d1,
      n_samples >= 20 and method in ('auto_point', 'grab') as d2, n_samples >= 10 as d3, true as d4, src = 1 as d5
    from a join m using (site)""")
def _(t):
    p = qc.site_profile(t.pred, "site", "y", "method", F.col("status") != "P")
    d = qc.quality_tiers(p, ["auto_point", "grab"])
    return d.withColumns({x: r(x) for x in ("std", "src_share", "median")})


SITE_R2 = """select site, 1 - sum((y - p) * (y - p)) / greatest(var_pop(y) * count(*), 1e-10) as r2, stddev_samp(y) as std
    from v_pred group by site"""


@query("qc_exclude_sites", f"""with s as ({SITE_R2}), q as (select max(std) as edge from s
      where std <= (select quantile_cont(std, 0.25) from s))
    select site, r2 < 0.7 as b1, r2 < 0.75 as b2, std < edge as b3 from s, q""")
def _(t):
    from freshet.operators.metrics import site_skill

    s = site_skill(t.pred, ["site"], "y", "p", ["r2"])
    low = qc.low_variance_sites(t.pred, "site", "y").withColumn("b3", F.lit(True))
    d = s.join(low, "site", "left")
    return d.select("site", (F.col("r2") < 0.7).alias("b1"), (F.col("r2") < 0.75).alias("b2"),
                    F.coalesce("b3", F.lit(False)).alias("b3"))
