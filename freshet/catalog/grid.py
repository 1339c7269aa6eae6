"""Regular grids, loads and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.joins import rsel
from freshet.catalog.metrics import AVGRANK, KGE, R2
from freshet.catalog.registry import query
from freshet.catalog.windows import GAP, GRID, SESS, SLICE, flow_grid, flow_long
from freshet.functions.basics import r
from freshet.operators import events as E, grid as G, loads as L


@query("grid_build", """select s.site, cast(s.day as timestamp) as time, q, conc, q is not null as covered
    from (select site, cast(unnest(generate_series(timestamp '1995-03-01', timestamp '1996-02-29', interval 1 day)) as date) as day from (select distinct site from v_flow)) s
    left join v_flow f on s.site = f.site and s.day = f.day""")
def _(t):
    """A given year of every site; later copies of a reading do not count."""
    rows = flow_long(t).withColumn("pos", F.lit(1))
    late = rows.where("site % 2 = 0").select("site", "day", "code", (F.col("value") - 1).alias("value"), F.lit(2).alias("pos"))
    g = G.build(rows.unionByName(late), "site", "code", "day", 86_400, {"q": "q", "conc": "conc"}, None, "q", "1995-03-01", "1996-02-29", "pos")
    return g.select("site", "time", "q", "conc", "covered")


@query("grid_interp", "select site, idx, R(q) as q, R(conc) as conc from v_fill", GRID)
def _(t):
    return flow_grid(t).select("site", "idx", *rsel("q", "conc"))


def _over(k: int, m: int = 0) -> str:
    return f"(partition by site order by idx rows between {k} preceding and {m} following)"


def _slope(col: str, width: int) -> str:
    """SQL: slope over a full window that also has a row behind it."""
    half = width // 2
    steps = [i - (width - 1) / 2 for i in range(width)]
    terms = " + ".join(f"{x}::double * {f'lag({col}, {half - i})' if i <= half else f'lead({col}, {i - half})'} over w" for i, x in enumerate(steps))
    return f"case when count({col}) over {_over(half, half - 1)} = {width} and lead(1, {half}) over w is not null then ({terms}) / {sum(x * x for x in steps)!r}::double end"


SENSORS = {"turb": "conc", "flow": "q", "cond": "case when idx % 11 = 0 then null else conc * 3.5 end", "do": "case when idx % 9 = 0 then null else 6 + idx % 7 end", "ph": "cast(7 + idx % 3 as double)", "temp": "cast(idx % 43 - 1 as double)"}
SENSOR_SQL = ", ".join(f"{v} as {k}" for k, v in SENSORS.items())
NUMERIC = ["turb", "flow", "cond", "do", "ph", "temp", "turb_mean", "turb_min", "turb_max", "turb_std", "turb_range", "turb_slope", "flow_slope", "rising_limb", "flow_week", "flow_month", "flow_ratio", "turb_flow_ratio",
           "do_departure", "cond_turb", "log_turb", "turb_saturated", "turb_below", "doy_sin", "doy_cos", "rain_1d", "rain_2d", "rain_7d", "rain_30d", "days_since_rain", "air_temp", "log_area", "flush"]
CATEGORIES = ["collection_method", "turb_source", "sensor_family"]
MEDIANS = {"flow": "q", "turb": "conc", "turb_slope": "conc / 100", "rain_7d": "q / 50"}  # columns of the training table
TK = "(greatest(least(temp, 40), 0) + 273.15::double)"
FEATURES = {**GRID,
    "v_gs": f"select site, idx, day, {SENSOR_SQL} from v_fill",
    "v_roll": f"""select *, avg(turb) over {_over(4, 3)} as turb_mean, min(turb) over {_over(4, 3)} as turb_min, max(turb) over {_over(4, 3)} as turb_max, coalesce(stddev_samp(turb) over {_over(4, 3)}, 0) as turb_std,
      {_slope('turb', 8)} as turb_slope, {_slope('flow', 16)} as flow_slope, case when count(flow) over {_over(6)} >= 3 then avg(flow) over {_over(6)} end as flow_week,
      case when count(flow) over {_over(29)} >= 3 then avg(flow) over {_over(29)} end as flow_month from v_gs window w as (partition by site order by idx)""",
    "v_wet": "select site, day, case when (dayofyear(day) * 13 + site) % 5 = 0 then null else cast((dayofyear(day) * 13 + site) % 7 as double) / 2 end as rain_mm, cast(dayofyear(day) % 30 as double) as tmean_c from v_flow where (dayofyear(day) + site) % 23 > 0",
    "v_wx": """select *, rn - last_value(case when rain_mm > 1 then rn end ignore nulls) over (partition by site order by day rows between unbounded preceding and current row) as days_since_rain from (select site, day, tmean_c as air_temp, rain_mm,
      row_number() over (partition by site order by day) as rn, coalesce(lag(rain_mm) over (partition by site order by day), 0) as rain_1d, """
      + ", ".join(f"sum(rain_mm) over (partition by site order by day rows between {k} preceding and 1 preceding) as rain_{k}d" for k in (2, 7, 30)) + " from v_wet)",
    "v_attr": "select site, area, case when site % 4 > 0 then region end as sensor_family from v_sites",
    "v_full": f"""select g.*, x.rain_1d, x.rain_2d, x.rain_7d, x.rain_30d, cast(x.days_since_rain as double) as days_since_rain, x.air_temp, ln(1 + greatest(area, 0)) as log_area, sensor_family,
      ln(1 + coalesce(x.days_since_rain, 0)) * ln(1 + coalesce(x.rain_1d, 0)) as flush, 'auto_point' as collection_method, 'continuous' as turb_source, turb_max - turb_min as turb_range, cast(flow_slope > 0 as int) as rising_limb,
      flow / nullif(flow_week, 0) as flow_ratio, turb / nullif(flow, 0) as turb_flow_ratio, cond * turb as cond_turb, ln(1 + greatest(turb, 0)) as log_turb, case when turb > 3000 then 1 else 0 end as turb_saturated,
      case when turb <= 0.5 then 1 else 0 end as turb_below, sin(2 * pi() * dayofyear(g.day) / 365.25) as doy_sin, cos(2 * pi() * dayofyear(g.day) / 365.25) as doy_cos,
      "do" - exp(-139.34411::double + 1.575701e5 / {TK} - 6.642308e7 / pow({TK}, 2) + 1.2438e10 / pow({TK}, 3) - 8.621949e11 / pow({TK}, 4)) as do_departure
      from v_roll g left join v_wx x on g.site = x.site and g.day = x.day left join v_attr a on g.site = a.site""",
    "v_med": "select " + ", ".join(f"quantile_cont({v}, 0.5) as m_{k}" for k, v in MEDIANS.items()) + " from v_flow",
}
FEATURES["v_gs"] = FEATURES["v_gs"].replace(" as do,", ' as "do",')


def sql_filled(x: str) -> str:
    q = '"do"' if x == "do" else x
    return f"R(coalesce({q}, {f'm_{x}, ' if x in MEDIANS else ''}0)) as {q}"


@query("grid_features", f"select site, idx, {', '.join(map(sql_filled, NUMERIC))}, {', '.join(f'coalesce({x}, {chr(39)}missing{chr(39)}) as {x}' for x in CATEGORIES)} from v_full, v_med", FEATURES)
def _(t):
    """All features of the grid with gaps filled from the training table."""
    from freshet.plans.features import grid_features

    grid = flow_grid(t).selectExpr("site", "idx", "time", *[f"cast({v} as double) as `{k}`" for k, v in SENSORS.items()])
    weather = t.flow.where("(dayofyear(day) + site) % 23 > 0").selectExpr(
        "site", "day", "case when (dayofyear(day) * 13 + site) % 5 = 0 then null else cast((dayofyear(day) * 13 + site) % 7 as double) / 2 end as rain_mm", "cast(dayofyear(day) % 30 as double) as tmean_c")
    attrs = t.sites.select("site", "area", F.when(F.col("site") % 4 > 0, F.col("region")).alias("sensor_family"))
    train = t.flow.selectExpr(*[f"{v} as {k}" for k, v in MEDIANS.items()])
    d = grid_features(grid, weather, attrs, train, "site", "idx", "time", NUMERIC, CATEGORIES, 7, 30, 3)
    return d.select("site", "idx", *rsel(*NUMERIC), *CATEGORIES)


@query("load_rate", "select site, day, R(conc * q * 0.0027) as load from v_flow")
def _(t):
    return t.flow.select("site", "day", r(L.rate("conc", "q")).alias("load"))


@query("load_daily", """select site, cast(time as date) as day, case when count(value * k) >= 3 then R(avg(value * k * 0.0027)) end as load, count(value * k) as n
    from v_base group by 1, 2""")
def _(t):
    d = t.base.withColumn("load", L.rate("value", "k"))
    return L.daily(d, "site", "time", "load", 3).withColumn("load", r("load"))


LOADS = {"v_load": "select site, day, q, conc, conc * q * 0.0027 as obs, conc * (0.8 + 0.05 * (dayofyear(day) % 9)) * q * 0.0027 as mod from v_flow"}


def loads(t):
    return t.flow.withColumn("obs", L.rate("conc", "q")).withColumn(
        "mod", L.rate(F.col("conc") * (0.8 + 0.05 * (F.dayofyear("day") % 9)), "q"))


@query("load_monthly", """select site, cast(date_trunc('month', day) as date) as month, count(*) as n_obs,
    case when count(*) >= 0.25 * day(last_day(any_value(day))) then R(sum(obs), 3) end as obs from v_load group by 1, 2""", LOADS)
def _(t):
    d = L.monthly(loads(t), ["site"], "day", ["obs"], 0.25)
    return d.select("site", "month", "n_obs", r("obs", 3).alias("obs"))


@query("load_water_year", """select site, cast(year(day) + case when month(day) >= 10 then 1 else 0 end as int) as wy, count(*) as n_obs,
    case when count(*) >= 70 then R(sum(obs), 2) end as obs from v_load group by 1, 2""", LOADS)
def _(t):
    d = L.yearly(loads(t), ["site"], "day", ["obs"], 70)
    return d.select("site", "wy", "n_obs", r("obs", 2).alias("obs"))


@query("load_timescales", """select grain, count(*) as n, R(sum(o), 1) as total_obs, R(sum(p), 1) as total_pred, R(sum(p) / sum(o)) as ratio from (
      select site, grain, date_trunc(grain, time) as s, sum(y * flow * 0.0027) as o, sum(p * flow * 0.0027) as p
      from (select *, unnest(['day', 'month', 'year']) as grain from v_pred) group by 1, 2, 3) where o > 0 and p > 0 group by grain""")
def _(t):
    d = t.pred.select("site", "time", L.rate("y", F.abs("flow")).alias("obs"), L.rate("p", F.abs("flow")).alias("pred"))
    return L.timescales(d, "site", "time", "obs", "pred").select("grain", "n", *rsel("total_obs", "total_pred", d=1), *rsel("ratio"))


CURVE = {"v_cal": "select site, log10(conc) as ly, log10(q) as lx from v_flow where day(day) <= 10 and conc > 0 and q > 0",
         "v_fit": "select site, count(*) as n_cal, covar_pop(lx, ly) / var_pop(lx) as slope, avg(ly) - covar_pop(lx, ly) / var_pop(lx) * avg(lx) as intercept from v_cal group by site having count(*) >= 3",
         "v_curve": "select site, n_cal, slope, intercept, least(greatest(avg(pow(10.0, ly - intercept - slope * lx)), 0.5), 5.0) as smear from v_cal join v_fit using (site) group by all"}


@query("load_rating_curve", """select site, day, n_cal, R(slope) as slope, R(smear) as smear,
    R(least(greatest(pow(10.0, intercept + slope * log10(greatest(q, 0.01))) * smear, 0), 1e6)) as conc_rated from v_flow join v_curve using (site)""", CURVE)
def _(t):
    fit = L.rating_curve(t.flow.where(F.day("day") <= 10), "site", "conc", "q")
    return t.flow.join(fit, "site").withColumn("conc_rated", L.rated("q")).select("site", "day", "n_cal", *rsel("slope", "smear", "conc_rated"))


def LM(src, by, o="obs", p="mod"):
    return f"""(select a.*, median_error_pct, spearman from (select {by}, count(*) as n, {R2(o, p)} as r2, {KGE(o, p)} as kge, 100 * (sum({p}) - sum({o})) / greatest(sum({o}), 1e-10) as pbias,
        sum({p}) / greatest(sum({o}), 1e-10) as total_ratio, sqrt(avg(pow({p} - {o}, 2))) as rmse,
        1 - sum(pow(ln(1 + greatest({p}, 0)) - ln(1 + greatest({o}, 0)), 2)) / greatest(var_pop(ln(1 + greatest({o}, 0))) * count(*), 1e-10) as log_nse,
        quantile_cont(abs({p} - {o}) / greatest({o}, 1e-3) * 100, 0.5) as median_error_pct
      from {src} group by {by} having count(*) >= 5) a join (select {by}, covar_pop(ro, rp) / nullif(stddev_pop(ro) * stddev_pop(rp), 0) as spearman
      from (select {by}, {AVGRANK(o, by)} as ro, {AVGRANK(p, by)} as rp from {src}) group by {by}) s using ({by}))"""


LMC = ["r2", "kge", "pbias", "total_ratio", "rmse", "log_nse", "median_error_pct", "spearman"]
LMS = ", ".join(f"R({x}) as {x}" for x in LMC)


@query("load_metrics", f"select site, n, {LMS} from {LM('v_load', 'site')}", LOADS)
def _(t):
    return L.load_metrics(loads(t), ["site"], "obs", "mod").select("site", "n", *rsel(*LMC))


@query("load_transport_days", f"select site, n, {LMS} from {LM('(select * from v_load where obs >= 1)', 'site')}", LOADS)
def _(t):
    return L.load_metrics(loads(t).where("obs >= 1"), ["site"], "obs", "mod").select("site", "n", *rsel(*LMC))


CMP = {**LOADS, **CURVE,
       "v_three": """select l.site, l.day, l.obs, l.mod, least(greatest(pow(10.0, intercept + slope * log10(greatest(q, 0.01))) * smear, 0), 1e6) * q * 0.0027 as ols
         from v_load l left join v_curve using (site)""",
       "v_scales": """select site, 'daily' as scale, obs, mod, ols from v_three union all select site, 'transport', obs, mod, ols from v_three where obs >= 1
         union all select site, 'monthly', case when count(obs) >= 0.25 * day(last_day(any_value(day))) then sum(obs) end, case when count(mod) >= 0.25 * day(last_day(any_value(day))) then sum(mod) end,
           case when count(ols) >= 0.25 * day(last_day(any_value(day))) then sum(ols) end from v_three group by site, date_trunc('month', day)
         union all select site, 'annual', case when count(obs) >= 70 then sum(obs) end, case when count(mod) >= 70 then sum(mod) end, case when count(ols) >= 70 then sum(ols) end
           from v_three group by site, year(day) + case when month(day) >= 10 then 1 else 0 end""",
       "v_long": """select site, scale, 'mod' as method, obs, mod as pred from v_scales where obs is not null and mod is not null
         union all select site, scale, 'ols', obs, ols from v_scales where obs is not null and ols is not null"""}


@query("load_compare", f"select site, scale, method, n, {LMS} from {LM('v_long', 'site, scale, method', 'obs', 'pred')}", CMP)
def _(t):
    fit = L.rating_curve(t.flow.where(F.day("day") <= 10), "site", "conc", "q")
    d = loads(t).join(fit, "site", "left").withColumn("ols", L.rate(L.rated("q"), "q")).select("site", "day", "obs", "mod", "ols")
    return L.compare(d, "site", "day", "obs", ["mod", "ols"], 0.25, 70).select("site", "scale", "method", "n", *rsel(*LMC))


TB = "over (partition by site order by day rows between 6 preceding and current row)"
EV = {"v_base7": f"select *, case when count(q) {TB} >= 3 then min(q) {TB} end as base, row_number() over (partition by site order by day) as rn, count(*) over (partition by site) as n from v_flow",
      "v_up": "select *, coalesce(q > 3 * base, false) as up, coalesce(lag(q > 3 * base) over (partition by site order by day), false) as was, max(day) over (partition by site) as lastday from v_base7 where n >= 7",
      "v_runs": "select *, sum(case when up and not was then 1 else 0 end) over (partition by site order by day) as run from v_up",
      "v_ev0": """select site, run, min(day) filter (up) as s, coalesce(min(day) filter (not up), any_value(lastday)) as e, min_by(base, day) as base from v_runs where run > 0 group by site, run""",
      "v_ev1": "select *, case when date_diff('day', lag(e) over (partition by site order by s), s) < 3 then 0 else 1 end as fresh from v_ev0 where date_diff('day', s, e) >= 2",
      "v_ev2": "select *, sum(fresh) over (partition by site order by s)::bigint as event from v_ev1",
      "v_evt": """select m.site, m.event, m.s, m.e, m.base, max(q) as peak from (select site, event, min(s) as s, max(e) as e, min_by(base, s) as base from v_ev2 group by 1, 2) m
        join v_flow f on f.site = m.site and f.day between m.s and m.e group by all"""}


def detected(t):
    return E.detect(t.flow, "site", "day", "q", rows=7, min_count=3, rise=3.0, min_h=48, sep_h=72, slice_s=120 * 86_400)


@query("evt_detect", "select site, event, s as start, e as \"end\", base as baseflow, peak, date_diff('day', s, e) * 24.0::double as duration_h from v_evt", EV)
def _(t):
    return detected(t).select("site", "event", "start", "end", "baseflow", "peak", "duration_h")


@query("evt_loads", """select v.site, event, R(sum(obs)) as obs, R(sum(mod)) as mod, case when sum(obs) > 0.1 then R(100 * (sum(mod) - sum(obs)) / sum(obs)) end as pct_mod
    from v_evt v join v_load l on v.site = l.site and l.day between v.s and v.e group by 1, 2""", {**EV, **LOADS})
def _(t):
    d = E.event_loads(detected(t), loads(t), "site", "day", "obs", ["mod"])
    return d.select("site", "event", *rsel("obs", "mod", "pct_mod"))


ST = {**SESS, "v_storm": """select site, session, count(*) as n, max(y) as peak, min(y) as low, max(flow) / greatest(min(flow), 1) as qr from v_sess group by 1, 2
    having count(*) >= 4 and max(y) / greatest(min(y), 1) >= 3"""}


@query("evt_sample_storms", "select site, session, n, peak, low from v_storm", ST)
def _(t):
    return E.sample_storms(t.pred, "site", "time", "oid", "y", GAP, SLICE, 4).select("site", "session", "n", "peak", "low")


@query("evt_top_per_site", "select site, session, n, peak from v_storm qualify row_number() over (partition by site order by peak desc, session) = 1 order by peak desc, site limit 4", ST)
def _(t):
    s = E.sample_storms(t.pred, "site", "time", "oid", "y", GAP, SLICE, 4)
    return E.best_per_site(s, "site", 4).select("site", "session", "n", "peak")


@query("evt_hysteresis_pick", "select site, session, n, peak from v_storm where qr >= 8 qualify row_number() over (partition by site order by peak desc, session) = 1 order by peak desc, site limit 4", ST)
def _(t):
    s = E.sample_storms(t.pred, "site", "time", "oid", "y", GAP, SLICE, 4, flow="flow", flow_ratio=8.0)
    return E.best_per_site(s, "site", 4).select("site", "session", "n", "peak")
