"""Data quality, lineage and qualification."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.functions import normalize as N, transforms as X
from freshet.functions.basics import r
from freshet.operators import joins as J, quality as Q

V1 = {"v_pt": "select site, time, y, ln(1 + y) as target, turb, flow, cast(oid % 900 as double) as gap, cast(null as double) as empty from v_pred"}


@query("dq_paired", """with d as (select sum(n - 1) as dup from (select count(*) as n from v_pt group by site, time))
    select 'site count' as "check", true as passed, count(distinct site)::double as detail from v_pt
    union all select 'lab value >= 0', min(y) >= 0, R(min(y)) from v_pt union all select 'match gap', max(gap) <= 900, R(max(gap)) from v_pt
    union all select 'unique key', dup = 0, dup::double from d union all select 'target is log1p', true, 0.0::double
    union all select 'no empty feature', count(empty) > 0 and count(turb) > 0 and count(flow) > 0, ((count(empty) = 0)::int + (count(turb) = 0)::int + (count(flow) = 0)::int)::double from v_pt""", V1)
def _(t):
    d = t.pred.select("site", "time", "y", F.log1p("y").alias("target"), "turb", "flow", (F.col("oid") % 900).cast("double").alias("gap"), F.lit(None).cast("double").alias("empty"))
    return Q.paired_checks(d, "site", "time", "y", "gap", "target", ["turb", "flow", "empty"], None).withColumn("detail", r("detail"))


@query("dq_features", """select 'doy_sin in [-1, 1]' as "check", true as passed, R(max(abs(sin(2 * pi() * dayofyear(time) / 365.25)))) as detail from v_pred
    union all select 'rising is binary', count(*) filter (oid % 3 = 2) = 0, (count(*) filter (oid % 3 = 2))::double from v_pred union all select 'no constant column', false, 1.0::double""")
def _(t):
    s, _c = X.season("time")
    d = t.pred.select(s.alias("doy_sin"), (F.col("oid") % 3).cast("double").alias("rising"), "turb", F.lit(1.0).alias("constant"))
    return Q.feature_checks(d, ["doy_sin"], ["rising"], ["turb", "constant"]).withColumn("detail", r("detail"))


@query("dq_pct_range", " union all ".join(f"select '{c}' as col, min({c})::double as lo, max({c})::double as hi, min({c}) >= -0.01 and max({c}) <= 100.01 as passed from v_sites" for c in ("clay_pct", "sand_pct", "area")))
def _(t):
    return Q.percent_checks(t.sites, ["clay_pct", "sand_pct", "area"])


@query("dq_merge", """select (select count(*) from v_pred) as n_before, count(*) as n_after, count(area) as nn_area, count(region) as nn_region,
    count(*) = (select count(*) from v_pred) and count(area) > 0 and count(region) > 0 as passed from v_pred left join v_sites using (site)""")
def _(t):
    return Q.merge_check(t.pred, J.attach(t.pred, t.sites.select("site", "area", "region"), "site"), ["area", "region"])


@query("dq_leakage", """with s as (select site, case when clay_pct < 20 then 'holdout' else 'training' end as role from v_sites)
    select count(distinct site) as n_leaked, count(distinct site) = 0 as passed from s where role <> 'training' and site in (select site from v_pred)""")
def _(t):
    split = t.sites.select("site", F.when(F.col("clay_pct") < 20, "holdout").otherwise("training").alias("role"))
    return Q.leakage(t.pred, split, "site")


def _marked(x: str) -> str:
    return f"coalesce(length({x}) || ':' || {x}, '~')"


HASHED = ["approval_status", "cast(event_id as varchar)", "cast(k as varchar)", "pcode", "qualifier", "cast(site as varchar)", "cast(epoch_us(time) as varchar)", "cast(cast(round(value * 1e8) as bigint) as varchar)"]


@query("dq_hash", f"""select count(*) as n_rows, sum(('0x' || substr(h, 1, 8))::bigint)::bigint as hash_a, sum(('0x' || substr(h, 9, 8))::bigint)::bigint as hash_b from
    (select md5({" || '|' || ".join(_marked(x) for x in HASHED)}) as h from v_obs)""")
def _(t):
    return Q.table_hash(t.obs.select("approval_status", "event_id", "k", "pcode", "qualifier", "site", "time", "value"))


@query("dq_golden", """select count(*) as n, R(max(abs(p - round(p * 8) / 8)), 3) as max_diff, 0 as n_missing, 0 as n_extra, max(abs(p - round(p * 8) / 8)) <= 0.07 as passed from v_pred""")
def _(t):
    stored = t.pred.select("oid", (F.floor(F.col("p") * 8 + 0.5) / 8).alias("p"))
    return Q.golden_check(t.pred, stored, ["oid"], "p", 0.07).withColumn("max_diff", r("max_diff", 3))


TBL = ["events", "orders", "lineitem", "customer"]
NCOL = {"events": 6, "orders": 6, "lineitem": 11, "customer": 5}


@query("dq_manifest", " union all ".join(f"select 'read_{x}' as step, '{x}.parquet' as file, count(*) as n_rows, {NCOL[x]} as n_columns from {x}" for x in TBL))
def _(t):
    return Q.manifest({f"read_{x}": t.table(x) for x in TBL})


@query("dq_censoring", """select coalesce(case param_code when '80154' then 'ssc' when '00665' then 'total_phosphorus' else param_code end, 'none') as param, site, count(*) as n_samples,
    count(*) filter (nd) as n_nondetect, round(count(*) filter (nd) / count(*)::double * 100, 1) as pct_censored, R(quantile_cont(case when nd then dl end, 0.5)) as median_limit,
    round(count(*) filter (nd) / count(*)::double * 100, 1) > 10 as high from (select *, coalesce(lower(condition) like '%not detect%', false) as nd, try_cast(limit_b as double) as dl from v_labraw) group by 1, 2""")
def _(t):
    p = F.coalesce(N.lookup(N.CODE_PARAMETERS, "param_code"), "param_code", F.lit("none"))
    nd = F.coalesce(F.lower("condition").contains("not detect"), F.lit(False))
    return Q.censoring(t.labraw.withColumn("param", p), ["param", "site"], nd, N.number("limit_b")).withColumn("median_limit", r("median_limit"))


@query("dq_discrete_valid", """select site, count(*) as n_total, count(v) as n_valid, count(*) - count(v) as n_missing, min(start_date) as first, max(start_date) as last, R(quantile_cont(v, 0.5)) as median,
    count(v) = 0 or min(v) = max(v) as suspicious from (select *, try_cast(measure as double) as v from v_labraw) group by site""")
def _(t):
    d = t.labraw.withColumn("v", N.number("measure"))
    return Q.discrete_validity(d, "site", "v", "start_date").withColumn("median", r("median"))


@query("dq_qualify", """select q.site, days as overlap_days, n as n_samples, n >= 14 as trainable, params from (select site, cast(floor((epoch_us(least(e1, e2)) - epoch_us(greatest(b1, b2))) / 86400000000) as bigint) as days, n
      from (select site, min(time) as b1, max(time) as e1 from v_obs where pcode = 'click' group by site) join (select site, min(time) as b2, max(time) as e2, count(*) as n from v_lab group by site) using (site)) q
    join (select site, string_agg(pcode, ',' order by pcode) as params from (select distinct site, pcode from v_obs) group by site) p using (site) where days >= 18 and n >= 10""")
def _(t):
    spans = J.record_span(t.obs, ["site", "pcode"], "time", "s")
    lab = J.record_span(t.lab, ["site"], "time", "lab")
    return Q.qualify(spans, lab, "site", "pcode", "click", 18, 10, 14)


CODES = ["click", "error", "signup", "view"]


@query("dq_param_matrix", "select site, " + ", ".join(f"count(*) filter (pcode = '{c}') as {c}" for c in CODES) + ", least(" + ", ".join(f"count(*) filter (pcode = '{c}')" for c in CODES)
       + ") >= 10 as all_viable, greatest(" + ", ".join(f"count(*) filter (pcode = '{c}')" for c in CODES) + ") >= 10 as any_viable from v_obs group by site")
def _(t):
    return Q.param_matrix(t.obs, "site", "pcode", CODES, 10)


@query("dq_gate", " union all ".join(f"select {k} as min_params, count(*) filter (k >= {k}) as n_sites from v_g" for k in (1, 2, 3, 4)),
       {"v_g": "select site, count(*) filter (n >= 13) as k from (select site, pcode, count(*) as n from v_obs group by 1, 2) group by site"})
def _(t):
    c = t.obs.groupBy("site", "pcode").agg(F.count("*").alias("n"))
    return Q.gate(c, "site", "n", 13, [1, 2, 3, 4])


@query("dq_gap_yield", """with j as (select l.site, l.time, b, e from (select site, time from v_pred) l left join (select l_suppkey as site, min(l_shipdate) as b, max(l_shipdate) - interval 500 day as e from lineitem group by 1) s using (site)),
    g as (select site, b, e, count(*) as n, count(*) filter (b is null or time < b) as nb, count(*) filter (time > e) as na, min(time) filter (b is null or time < b) as f, max(time) filter (time > e) as l, max(time) as m from j group by 1, 2, 3)
    select site, n as n_samples, nb as n_before, na as n_after, n - nb - na as n_inside, cast(case when nb > 0 then greatest(year(coalesce(b, m)) - year(f), 0) else 0 end + case when na > 0 then greatest(year(l) - year(e), 0) else 0 end as int) as site_years,
      cast(floor((nb + na) * 0.6::double) as bigint) as expected, case when nb + na = 0 then '0' when nb + na < 5 then '1-4' when nb + na < 10 then '5-9' when nb + na < 20 then '10-19' when nb + na < 50 then '20-49'
        when nb + na < 100 then '50-99' when nb + na < 500 then '100-499' else '500+' end as outside_bin from g""")
def _(t):
    span = t.table("lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.min("l_shipdate").alias("rec_begin"), F.expr("max(l_shipdate) - interval 500 days").alias("rec_end"))
    return Q.gap_yield(t.pred.select("site", "time"), span, "site", "time", "rec", 0.6)


@query("dq_param_counts", """select pcode, sum(n)::bigint as n_samples, count(*) as n_sites, min(lo) as lo, max(hi) as hi, count(*) filter (n >= 5) as sites_5, count(*) filter (n >= 10) as sites_10, R(quantile_cont(n, 0.5)) as median_per_site
    from (select pcode, site, count(*) as n, min(value) as lo, max(value) as hi from v_base group by 1, 2) group by pcode""")
def _(t):
    return Q.param_counts(t.base, "pcode", "site", "value").withColumn("median_per_site", r("median_per_site"))


@query("dq_viable_sites", "select site, n from (select site, count(*) as n from v_lab where time between (select min(time) + interval 5 day from v_base) and (select max(time) - interval 5 day from v_base) group by site) where n >= 9")
def _(t):
    span = t.base.agg(F.expr("min(time) + interval 5 days").alias("_a"), F.expr("max(time) - interval 5 days").alias("_b"))
    from freshet.functions.basics import with_scalar

    audit = with_scalar(t.lab, span).where("time between _a and _b").groupBy("site").agg(F.count("*").alias("n"))
    return audit.where("n >= 9")


@query("dq_discover", """select site, n as n_samples, region, lat from (select site, count(*) as n from v_lab group by site having count(*) >= 13) join v_sites using (site)""")
def _(t):
    meta = t.sites.select("site", "region", "lat").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return Q.discover(t.lab, meta, "site", "copy", 13).select("site", "n_samples", "region", "lat")
