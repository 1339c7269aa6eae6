"""Normalisation, scalar functions and feature expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.functions import normalize as N, transforms as X
from freshet.functions.basics import r
from freshet.operators import qc

LIMITS = ["limit_a", "limit_b"]


@query("norm_approval", """select event_id, case trim(split_part(approval_status, ',', 1)) when 'A' then 'Approved'
    when 'P' then 'Provisional' else approval_status end as status from v_obs""")
def _(t):
    return t.obs.select("event_id", N.approval("approval_status").alias("status"))


@query("norm_qualifier", """select event_id,
    nullif(array_to_string(list_filter(string_split(trim(regexp_replace(upper(coalesce(qualifier, '')),
      '[\\[\\]''",\\s]+', ' ', 'g')), ' '), lambda x: x <> ''), '|'), '') as codes,
    nullif(array_to_string(string_split(cd, ', ')[2:], ', '), '') as remainder,
    case substr(cd, 1, 1) when 'A' then 'Approved' when 'P' then 'Provisional' else 'Unknown' end as status
    from (select *, approval_status || case when k % 3 = 0 then ', e, Ice' else '' end as cd from v_obs)""")
def _(t):
    cd = F.concat("approval_status", F.when(F.col("k") % 3 == 0, ", e, Ice").otherwise(""))
    return t.obs.withColumn("cd", cd).select(
        "event_id", F.nullif(F.array_join(N.qualifier_codes("qualifier"), "|"), F.lit("")).alias("codes"),
        N.batch_qualifier("cd").alias("remainder"), N.batch_approval("cd").alias("status"),
    )


TZ_CASE = "case start_tz when 'EST' then -5 when 'CST' then -6 when 'PST' then -8 when 'UTC' then 0 when 'EDT' then -4 end"


@query("norm_utc", f"""select pos, site, try_cast(start_date || ' ' || nullif(start_time, '') as timestamp)
    - to_hours({TZ_CASE}) as time_utc from v_labraw
    where nullif(start_time, '') is not null and {TZ_CASE} is not null""")
def _(t):
    return t.labraw.select("pos", "site", N.to_utc("start_date", "start_time", "start_tz").alias("time_utc")).where(
        "time_utc is not null"
    )


@query("norm_utc_state", """select pos, try_cast(start_date || ' ' || start_time as timestamp)
    - to_hours(case state when 'MT' then -7 when 'NE' then -6 when 'KS' then -6 when 'WA' then -8 else -7 end) as time_utc
    from (select *, ['MT', 'NE', 'KS', 'WA', 'ZZ'][cast(site % 5 + 1 as int)] as state from v_labraw)
    where nullif(start_time, '') is not null""")
def _(t):
    states = F.array(*[F.lit(x) for x in ["MT", "NE", "KS", "WA", "ZZ"]])
    d = t.labraw.withColumn("state", F.element_at(states, (F.col("site") % 5 + 1).cast("int")))
    return d.select("pos", N.to_utc_state("start_date", "start_time", "state").alias("time_utc")).where(
        "time_utc is not null"
    )


@query("norm_numeric", "select pos, try_cast(measure as double) as value, try_cast(limit_b as double) as lim from v_labraw")
def _(t):
    return t.labraw.select("pos", N.number("measure").alias("value"), N.number("limit_b").alias("lim"))


@query("norm_dialect", """select pos, start_date as sample_date, try_cast(measure as double) as value, condition
    from v_labraw where pos % 2 = 0
    union all select pos, start_date, try_cast(measure as double), null from v_labraw where pos % 2 = 1""")
def _(t):
    a = t.labraw.where("pos % 2 = 0").select(
        "pos", F.col("start_date").alias("Activity_StartDate"), F.col("measure").alias("Result_Measure"),
        F.col("condition").alias("Result_ResultDetectionCondition"))
    b = t.labraw.where("pos % 2 = 1").select(
        "pos", F.col("start_date").alias("ActivityStartDate"), F.col("measure").alias("ResultMeasureValue"))
    from freshet.sources.lab import unify_dialects

    return unify_dialects([a, b]).select("pos", "sample_date", N.number("measure").alias("value"), "condition")


@query("norm_site_id", """select c_custkey, 'ST-' || case when length(s) <= 7 then '0' || s else s end as station,
    case when length(z) < 8 then lpad(z, 8, '0') when length(z) = 9 and z like '0%' then substr(z, 2, 8) else z end as padded
    from (select c_custkey, cast(c_custkey * 7919 as varchar) as s,
      case when c_custkey % 2 = 0 then cast(c_custkey * 7919 as varchar) else lpad(cast(c_custkey as varchar), 9, '0') end as z
      from customer)""")
def _(t):
    s = (F.col("c_custkey") * 7919).cast("string")
    z = F.when(F.col("c_custkey") % 2 == 0, s).otherwise(F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return t.table("customer").select("c_custkey", N.site_number(s).alias("station"), N.pad8(z).alias("padded"))


@query("norm_huc", """select c_custkey, lpad(cast(try_cast(nullif(h, 'unknown') as int) as varchar), 2, '0') as huc2,
    substr(lpad(cast(c_custkey * 977 % 21000000 as varchar), 8, '0'), 1, 2) as huc2_of_8
    from (select *, case when c_custkey % 7 = 0 then 'unknown' else cast(c_nationkey as varchar) end as h from customer)""")
def _(t):
    h = F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise(F.col("c_nationkey").cast("string"))
    h8 = F.lpad((F.col("c_custkey") * 977 % 21000000).cast("string"), 8, "0")
    return t.table("customer").select("c_custkey", N.region_code(h).alias("huc2"), F.substring(h8, 1, 2).alias("huc2_of_8"))


@query("nondetect_dl2", """with d as (select *, coalesce(lower(condition) like '%not detect%', false) as nd,
      try_cast(measure as double) as v from v_labraw),
    h as (select site, max(case when nd and try_cast(limit_a as double) is not null then 1 else 0 end) as ha,
      max(case when nd and try_cast(limit_b as double) is not null then 1 else 0 end) as hb from d group by site),
    e as (select d.*, coalesce(case when ha = 1 then try_cast(limit_a as double) when hb = 1
      then try_cast(limit_b as double) end, v) as dl from d join h using (site))
    select pos, nd as is_nondetect, case when nd then (case when dl > 0 then dl else 1.0 end) / 2 else v end as value from e""")
def _(t):
    d = t.labraw.withColumn("value", N.number("measure"))
    d = qc.substitute_nondetects(d, "site", "value", LIMITS, "condition", N.DEFAULT_LIMITS["ssc"])
    return d.select("pos", "is_nondetect", "value")


@query("classify_method", """select pos, case when e like '%automatic%' or e like '%peristaltic%' or e like '%submersible%'
      then 'auto_point' when e like '%dh-%' or e like '%us d%' or e like '%bag sampler%' then 'depth_integrated'
      when e like '%grab%' or e like '%kemmerer%' then 'grab' else 'unknown' end as method
    from (select pos, coalesce(lower(equipment), '') as e from v_labraw)""")
def _(t):
    return t.labraw.select("pos", N.collection_method("equipment").alias("method"))


@query("classify_sensor", """select pos, case upper(trim(code)) when 'TS213' then 'exo' when 'TS087' then 'ysi_6series'
      when 'TS086' then 'ysi_6026' else 'unknown' end as family
    from (select pos, case pos % 4 when 0 then ' ts213' when 1 then 'TS087' when 2 then 'TS086' end as code from v_labraw)""")
def _(t):
    code = F.expr("case pos % 4 when 0 then ' ts213' when 1 then 'TS087' when 2 then 'TS086' end")
    return t.labraw.select("pos", N.sensor_family(code).alias("family"))


@query("classify_feature", """select p_partkey, f as feature, case when f in ('geol_class', 'huc2') then 'method'
      when f like 'turbidity%' or f like 'do\\_%' escape '\\' or f like 'Q\\_%' escape '\\' then 'sensor'
      when f like 'precip\\_%' escape '\\' then 'weather' when f like 'clay\\_%' escape '\\' then 'geology' else 'watershed' end as category
    from (select p_partkey, ['turbidity_', 'do_', 'precip_', 'clay_', 'forest_', 'geol_class', 'huc2', 'Q_', 'zz_'][cast(p_partkey % 9 + 1 as int)]
      || case when p_partkey % 9 in (5, 6) then '' else cast(p_size as varchar) end as f from part)""")
def _(t):
    stem = F.element_at(
        F.array(*[F.lit(x) for x in ["turbidity_", "do_", "precip_", "clay_", "forest_", "geol_class", "huc2", "Q_", "zz_"]]),
        (F.col("p_partkey") % 9 + 1).cast("int"))
    f = F.concat(stem, F.when((F.col("p_partkey") % 9).isin(5, 6), "").otherwise(F.col("p_size").cast("string")))
    return t.table("part").select("p_partkey", f.alias("feature")).withColumn("category", N.feature_category("feature"))


RAW_ATTR = {
    "pctdecid2019ws": "cast(nation as double)", "pctconif2019ws": "case when site % 3 = 0 then null else geol * 1.5 end",
    "pctcrop2019ws": "n_dams * 0.5", "pcturbhi2019ws": "case when site % 4 = 0 then null else clay_pct * 0.25 end",
    "pctsilicicws": "case when site % 6 = 0 then 0 else clay_pct * 1.0 end",
    "pctglactilloamws": "case when site % 6 = 0 then null else sand_pct * 1.0 end",
    "pctwaterws": "case when site % 6 = 0 then 0 else nation * 2.0 end", "clayws": "clay_pct * 1.0", "wsareasqkm": "area",
    "pctdecid2001ws": "nation * 1.25", "pcturbop2001ws": "case when site % 5 = 0 then null else sand_pct * 0.5 end",
}
RAW_SQL = ", ".join(f"cast({v} as double) as {k}" for k, v in RAW_ATTR.items())


def raw_attrs(t):
    return t.sites.selectExpr("site", *[f"cast({v} as double) as {k}" for k, v in RAW_ATTR.items()])


@query("attr_map", f"""select site, wsareasqkm as drainage_area_km2,
      coalesce(pctdecid2019ws, 0) + coalesce(pctconif2019ws, 0) as forest_pct, coalesce(pctcrop2019ws, 0) as agriculture_pct,
      coalesce(pcturbhi2019ws, 0) as developed_pct, pctsilicicws as pct_siliciclastic,
      pctglactilloamws as pct_glacial_till_loam, pctwaterws as pct_water_geology, clayws as clay_pct,
      cast(null as double) as sand_pct, pctdecid2001ws as pctdecid_2001, pcturbop2001ws as pcturbop_2001, case when coalesce(pctsilicicws, 0) + coalesce(pctglactilloamws, 0) + coalesce(pctwaterws, 0) = 0 then null
        when coalesce(pctsilicicws, 0) >= greatest(coalesce(pctglactilloamws, 0), coalesce(pctwaterws, 0)) then 'siliciclastic'
        when coalesce(pctglactilloamws, 0) >= coalesce(pctwaterws, 0) then 'glacial_till_loam' else 'water_geology' end as geol_class
    from (select site, {RAW_SQL} from v_sites)""")
def _(t):
    from freshet.operators.attributes import map_attributes

    d = map_attributes(raw_attrs(t), "site")
    return d.select("site", "drainage_area_km2", "forest_pct", "agriculture_pct", "developed_pct", "pct_siliciclastic",
                    "pct_glacial_till_loam", "pct_water_geology", "clay_pct", "sand_pct", "pctdecid_2001", "pcturbop_2001", "geol_class")


@query("attr_dominant", f"""select site, case when coalesce(pctsilicicws, 0) + coalesce(pctglactilloamws, 0) + coalesce(pctwaterws, 0) = 0 then null
        when coalesce(pctsilicicws, 0) >= greatest(coalesce(pctglactilloamws, 0), coalesce(pctwaterws, 0)) then 'silicic'
        when coalesce(pctglactilloamws, 0) >= coalesce(pctwaterws, 0) then 'till' else 'water' end as dominant
    from (select site, {RAW_SQL} from v_sites)""")
def _(t):
    return raw_attrs(t).select(
        "site", X.dominant({"pctsilicicws": "silicic", "pctglactilloamws": "till", "pctwaterws": "water"}).alias("dominant"))


@query("attr_prune", """select site, forest as forest_pct, crops + 0 as agriculture_pct, dev as developed_pct,
      greatest(100 - forest - crops - dev, 0) as other_landcover_pct, tmax - tmin as temp_range_c, dams as n_dams,
      0.0::double as dam_storage, cast(null as double) as road_density, clay as clay_pct, sand as sand_pct, clay - sand as relief_m, cls as reference_class
    from (select site, cast(clay_pct * 0.5 as double) as forest, cast(sand_pct * 0.5 as double) as crops, cast(nation as double) as dev, area as tmax,
      cast(n_dams as double) as tmin, cast(n_dams as double) as dams, cast(clay_pct as double) as clay, cast(sand_pct as double) as sand, region as cls from v_sites)""")
def _(t):
    from freshet.operators.attributes import prune_attributes

    raw = t.sites.selectExpr(
        "site", "cast(clay_pct * 0.5 as double) as FORESTNLCD06", "cast(sand_pct * 0.5 as double) as CROPSNLCD06",
        "cast(nation as double) as DEVNLCD06", "area as T_MAX_BASIN", "cast(n_dams as double) as T_MIN_BASIN",
        "cast(n_dams as double) as NDAMS_2009", "cast(clay_pct as double) as CLAYAVE", "cast(sand_pct as double) as SANDAVE", "area as T_AVG_BASIN",
        "cast(clay_pct as double) as ELEV_MAX_M_BASIN", "cast(sand_pct as double) as ELEV_MIN_M_BASIN", "area as ELEV_MEAN_M_BASIN", "region as CLASS")
    d = prune_attributes(raw, "site")
    return d.select("site", "forest_pct", "agriculture_pct", "developed_pct", "other_landcover_pct", "temp_range_c",
                    "n_dams", "dam_storage", "road_density", "clay_pct", "sand_pct", "relief_m", "reference_class")


@query("attr_drop_cols", "select site, clay_pct, area from v_sites")
def _(t):
    from freshet.operators.attributes import drop_empty_and_yearly

    d = t.sites.select("site", "clay_pct", "area", F.lit(None).cast("double").alias("empty"),
                       F.col("sand_pct").alias("forest_loss_2013"))
    return drop_empty_and_yearly(d, "site")


@query("attr_rename_pivot", """select o_custkey // 10 as site,
      R(coalesce(sum(o_totalprice) filter (o_orderstatus = 'O'), 0), 2) as lith_sedimentary_clastic,
      R(coalesce(sum(o_totalprice) filter (o_orderstatus = 'F'), 0), 2) as lith_water,
      0.0::double as lith_melange from orders group by 1""")
def _(t):
    from freshet.operators.attributes import pivot_classes

    d = t.table("orders").selectExpr(
        "o_custkey div 10 as site",
        "case o_orderstatus when 'O' then 'Sedimentary, clastic' when 'F' then 'Water' else 'Elsewhere' end as lith",
        "o_totalprice as pct")
    names = {"Sedimentary, clastic": "lith_sedimentary_clastic", "Water": "lith_water", "Melange": "lith_melange"}
    p = pivot_classes(d, ["site"], "lith", "pct", names)
    return p.select("site", *[r(x, 2).alias(x) for x in names.values()])


LAM = 0.2


@query("fx_transform", f"""select oid, R(ln(1 + y)) as log1p, R((pow(y + 1, {LAM}) - 1) / {LAM}) as boxcox,
    R(sqrt(y)) as sqrt, y as none from v_pred""")
def _(t):
    return t.pred.select("oid", *[r(X.forward("y", k, LAM)).alias(k) for k in ("log1p", "boxcox", "sqrt")],
                         X.forward("y", "none").alias("none"))


@query("fx_inverse", f"""select oid, R(exp(z) - 1, 3) as log1p,
    R(least(greatest(pow(greatest(z - 6, {-1 / LAM + 1e-10}) * {LAM} + 1, {1 / LAM}) - 1, 0), 1e8), 3) as boxcox, R(z * z, 3) as sqrt
    from (select oid, ln(1 + y) as z from v_pred)""")
def _(t):
    d = t.pred.select("oid", F.log1p("y").alias("z"))
    return d.select("oid", r(X.inverse("z", "log1p"), 3).alias("log1p"),
                    r(X.inverse(F.col("z") - 6, "boxcox", LAM), 3).alias("boxcox"), r(X.inverse("z", "sqrt"), 3).alias("sqrt"))


@query("fx_cross_sensor", "select oid, R(turb / nullif(flow - 10, 0)) as turb_flow_ratio, R(rain_mm * turb) as cond_turb from v_pred")
def _(t):
    d = t.pred.select("oid", F.col("turb").alias("turbidity_instant"), (F.col("flow") - 10).alias("discharge_instant"),
                      F.col("rain_mm").alias("conductance_instant"))
    return X.cross_sensor(d).select("oid", r("turb_flow_ratio").alias("turb_flow_ratio"), r("cond_turb").alias("cond_turb"))


@query("fx_do_departure", """select oid, R(dox - exp(-139.34411 + 1.575701e5 / k - 6.642308e7 / (k * k) + 1.2438e10 / (k * k * k)
      - 8.621949e11 / (k * k * k * k))) as departure
    from (select oid, rain_mm / 8 as dox, least(greatest(dry_days - 20, 0), 40) + 273.15 as k from v_pred)""")
def _(t):
    return t.pred.select("oid", r(F.col("rain_mm") / 8 - X.oxygen_saturation(F.col("dry_days") - 20)).alias("departure"))


@query("fx_season", """select oid, R(sin(2 * pi() * dayofyear(time) / 365.25)) as doy_sin,
    R(cos(2 * pi() * dayofyear(time) / 365.25)) as doy_cos from v_pred""")
def _(t):
    s, co = X.season("time")
    return t.pred.select("oid", r(s).alias("doy_sin"), r(co).alias("doy_cos"))


@query("fx_flags", """select event_id, R(ln(1 + case when value < 0 then 0 else value end)) as log_turb,
    cast(coalesce(value > 150, false) as double) as saturated, cast(coalesce(value <= 0.5, false) as double) as below
    from v_obs""")
def _(t):
    from freshet.functions.basics import clip

    return t.obs.select("event_id", r(F.log1p(clip("value", 0))).alias("log_turb"),
                        X.flag(F.col("value") > 150).alias("saturated"), X.flag(F.col("value") <= 0.5).alias("below"))


@query("fx_flush", """select oid, R(ln(1 + d) * ln(1 + rain_mm)) as flush from
    (select oid, rain_mm, case when dry_days > 90 then null else dry_days end as d from v_pred)""")
def _(t):
    return t.pred.select("oid", r(X.flush(F.expr("case when dry_days > 90 then null else dry_days end"), "rain_mm")).alias("flush"))


@query("fx_temp", "select site, day, R((tmax_c + 273.15) - 273.15) as tmax, R(((tmax_c + tmin_c) / 2)) as tmean from v_daily")
def _(t):
    return t.daily.select("site", "day", r(F.col("tmax_c") + 273.15 - 273.15).alias("tmax"),
                          r((F.col("tmax_c") + F.col("tmin_c")) / 2).alias("tmean"))


@query("fx_log_area", "select site, R(ln(1 + greatest(area - 300, 0))) as log_area from v_sites")
def _(t):
    from freshet.functions.basics import clip

    return t.sites.select("site", r(F.log1p(clip(F.col("area") - 300, 0))).alias("log_area"))


@query("fx_impute", """with d as (select oid, site, case when oid % 6 = 0 then null else turb end as turb,
      case when oid % 5 = 0 then null else flow end as flow, nullif(family, 'unknown') as family from v_pred),
    m as (select quantile_cont(turb, 0.5) as mt, quantile_cont(flow, 0.5) as mf from d where site % 4 <> 0)
    select oid, R(coalesce(turb, mt)) as turb, R(coalesce(flow, mf)) as flow, coalesce(family, 'missing') as family from d, m""")
def _(t):
    d = t.pred.selectExpr("oid", "site", "case when oid % 6 = 0 then null else turb end as turb",
                          "case when oid % 5 = 0 then null else flow end as flow", "nullif(family, 'unknown') as family")
    out = X.impute(d, d.where("site % 4 <> 0"), ["turb", "flow"], ["family"])
    return out.select("oid", r("turb").alias("turb"), r("flow").alias("flow"), "family")


@query("fx_weights", """select oid, R(sqrt(y) / avg(sqrt(y)) over ()) as w_sqrt, R(ln(1 + y) / avg(ln(1 + y)) over ()) as w_log,
    R(y / avg(y) over ()) as w_linear from v_pred""")
def _(t):
    d = t.pred.select("oid", "y")
    for s in ("sqrt", "log", "linear"):
        d = X.sample_weights(d, "y", s, f"w_{s}")
    return d.select("oid", *[r(f"w_{s}").alias(f"w_{s}") for s in ("sqrt", "log", "linear")])


@query("fx_bin_cut", """select oid, case when turb > 0 and turb <= 10 then '<10' when turb > 10 and turb <= 50 then '10-50'
      when turb > 50 and turb <= 200 then '50-200' when turb > 200 and turb <= 1000 then '200-1000' end as turb_tier,
    case when p >= 0 and p < 30 then '0-30' when p >= 30 and p < 100 then '30-100' when p >= 100 and p < 500 then '100-500'
      when p >= 500 and p < 2000 then '500-2000' when p >= 2000 then '2000+' end as pred_bin from v_pred""")
def _(t):
    return t.pred.select(
        "oid", X.bin_right("turb", [0, 10, 50, 200, 1000], ["<10", "10-50", "50-200", "200-1000"]).alias("turb_tier"),
        X.bin_left("p", [0, 30, 100, 500, 2000], ["0-30", "30-100", "100-500", "500-2000", "2000+"]).alias("pred_bin"))


@query("fx_bin_qcut", """with s as (select site, stddev_samp(y) as std from v_pred group by site),
    q as (select quantile_cont(std, 0.25) as a, quantile_cont(std, 0.5) as b, quantile_cont(std, 0.75) as c from s)
    select site, case when std <= a then 'Q1_low' when std <= b then 'Q2_med' when std <= c then 'Q3_high' else 'Q4_extreme' end as tier
    from s, q where std is not null""")
def _(t):
    s = t.pred.groupBy("site").agg(F.stddev_samp("y").alias("std")).where("std is not null")
    return X.quantile_bins(s, "std", ["Q1_low", "Q2_med", "Q3_high", "Q4_extreme"], "tier").select("site", "tier")
