"""Window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.joins import JV, rsel, samples
from freshet.catalog.metrics import R2
from freshet.catalog.registry import query
from freshet.functions import special as SP
from freshet.functions.basics import micros, r, value_block
from freshet.operators import metrics as MT, windows as WN
from freshet.operators.blocks import ordered
from freshet.operators.matching import trailing_mean, window_stats

KEYS = ["site", "pos", "sample_time"]


def flow_series(t):
    return t.obs.where("pcode = 'view' and value is not null").select("site", "time", "value")


WV = {**JV, "v_q": "select site, time as rt, value as rv from v_obs where pcode = 'view' and value is not null",
      "v_rich": "select * from v_q where site in (select site from v_q group by site having count(*) >= 12)"}


def SLOPE(rd, half):
    return f"""(select pos, case when count(*) < 2 then null when var_pop(x) = 0 then 0 else covar_pop(x, rv) / nullif(var_pop(x), 0) end as slope
      from (select pos, rv, floor((epoch_us(rt) - min(epoch_us(rt)) over (partition by pos)) / 1e6) as x
        from v_s s join {rd} r on s.site = r.site and abs(epoch_us(rt) - epoch_us(st)) <= {half}000000) group by pos)"""


def BACK(rd, days):
    return f"(select pos, avg(rv) as m from v_s s join {rd} r on s.site = r.site and rt between st - interval {days} day and st group by pos)"


@query("win_slope_2h", f"select pos, R(slope, 8) as flow_slope, cast(slope > 0 as double) as rising from v_s left join {SLOPE('v_q', 48 * 3600)} x using (pos)", WV)
def _(t):
    d = window_stats(samples(t), flow_series(t), ["site"], KEYS, "sample_time", "time", "value", 48 * 3600, short_slope=None)
    d = samples(t).select(*KEYS).join(d.select("pos", "window_slope"), "pos", "left")
    return d.select("pos", r("window_slope", 8).alias("flow_slope"), (F.col("window_slope") > 0).cast("double").alias("rising"))


@query("win_antecedent", f"""select pos, R(a.m) as mean_7d, R(b.m) as mean_30d, R(case when a.m > 0 then lab_value / a.m end) as ratio_7d
    from v_s left join {BACK('v_q', 7)} a using (pos) left join {BACK('v_q', 30)} b using (pos)""", WV)
def _(t):
    s, q = samples(t), flow_series(t)
    a = trailing_mean(s, q, ["site"], KEYS, "sample_time", "time", "value", 7, "mean_7d")
    b = trailing_mean(s, q, ["site"], KEYS, "sample_time", "time", "value", 30, "mean_30d")
    d = s.join(a, KEYS, "left").join(b, KEYS, "left").withColumn("ratio_7d", WN.flow_ratio("lab_value", "mean_7d"))
    return d.select("pos", *rsel("mean_7d", "mean_30d", "ratio_7d"))


@query("win_min_points", f"""select pos, R(slope, 8) as flow_slope, cast(slope > 0 as double) as rising, R(m) as mean_7d from v_s
    left join {SLOPE('v_rich', 48 * 3600)} x using (pos) left join {BACK('v_rich', 7)} a using (pos)""", WV)
def _(t):
    d = WN.hydrograph(samples(t).select(*KEYS), flow_series(t), "site", KEYS, "sample_time", 48 * 3600, {"mean_7d": 7}, 12)
    return d.select("pos", r("flow_slope", 8).alias("flow_slope"), "rising", r("mean_7d").alias("mean_7d"))


RAINW = "(partition by site order by day rows between {} preceding and 1 preceding)"


@query("win_rain_lag", "select site, day, " + ", ".join(f"R(sum(precip_mm) over {RAINW.format(n)}) as rain_{n}d" for n in (1, 2, 7, 30)) + " from v_daily")
def _(t):
    return WN.rain_features(t.daily, "site", "day", "precip_mm").select("site", "day", *rsel("rain_1d", "rain_2d", "rain_7d", "rain_30d"))


@query("win_days_since", """select site, day, cast(rn - max(case when precip_mm > 1 then rn end) over (partition by site order by day) as double) as days_since_rain
    from (select *, row_number() over (partition by site order by day) as rn from v_daily)""")
def _(t):
    return WN.rain_features(t.daily, "site", "day", "precip_mm").select("site", "day", "days_since_rain")


GRID = {"v_span": "select site, min(day) as a, max(day) as z from v_flow group by site",
        "v_grid": """select g.site, g.day, q, conc, cast(epoch_us(cast(g.day as timestamp)) // 86400000000 as bigint) as idx
          from (select site, cast(unnest(generate_series(cast(a as timestamp), cast(z as timestamp), interval 1 day)) as date) as day from v_span) g
          left join v_flow f on g.site = f.site and g.day = f.day""",
        # fill: 8 steps behind a reading, linear to the next one, flat at the end
        "v_fill": """select site, day, idx, case when q is not null then q when idx - pi <= 8 then case when ni is null then pv else pv + (nv - pv) * ((idx - pi)::double / (ni - pi)) end end as q,
            case when conc is not null then conc when idx - pi <= 8 then case when ni is null then pc else pc + (nc - pc) * ((idx - pi)::double / (ni - pi)) end end as conc
          from (select *, max(case when q is not null then idx end) over b as pi, min(case when q is not null then idx end) over f as ni,
              last_value(q ignore nulls) over b as pv, first_value(q ignore nulls) over f as nv, last_value(conc ignore nulls) over b as pc, first_value(conc ignore nulls) over f as nc from v_grid
            window b as (partition by site order by idx rows between unbounded preceding and current row), f as (partition by site order by idx rows between current row and unbounded following))"""}


def flow_long(t):
    return t.flow.selectExpr("site", "day", "stack(2, 'q', q, 'conc', conc) as (code, value)")


def flow_grid(t, limit=8):
    from freshet.operators.grid import build

    return build(flow_long(t), "site", "code", "day", 86_400, {"q": "q", "conc": "conc"}, limit, cover="q")


FRAME = "over (partition by site order by idx rows between 4 preceding and 3 following)"


@query("win_centered", f"""select site, idx, R(avg(q) {FRAME}) as c_mean, R(min(q) {FRAME}) as c_min, R(max(q) {FRAME}) as c_max,
    R(coalesce(stddev_samp(q) {FRAME}, 0)) as c_std, R(max(q) {FRAME} - min(q) {FRAME}) as c_range from v_fill""", GRID)
def _(t):
    d = WN.centered_stats(flow_grid(t).select("site", "idx", "q"), ["site"], "idx", "q")
    return d.select("site", "idx", *rsel("c_mean", "c_min", "c_max", "c_std", "c_range"))


@query("win_conv_slope", f"""select site, idx, R(case when count(q) {FRAME} = 8 and lead(1, 4) over (partition by site order by idx) is not null
    then (-3.5 * lag(q, 4) over w - 2.5 * lag(q, 3) over w - 1.5 * lag(q, 2) over w - 0.5 * lag(q, 1) over w + 0.5 * q + 1.5 * lead(q, 1) over w
      + 2.5 * lead(q, 2) over w + 3.5 * lead(q, 3) over w) / 42.0 end) as slope from v_fill window w as (partition by site order by idx)""", GRID)
def _(t):
    d = WN.fixed_slope(flow_grid(t).select("site", "idx", "q"), ["site"], "idx", "q", 8, "slope")
    return d.select("site", "idx", r("slope").alias("slope"))


def TRAIL(k):
    return f"over (partition by site order by idx rows between {k - 1} preceding and current row)"


@query("win_trailing_mean", f"""select site, idx, R(case when count(q) {TRAIL(30)} >= 7 then avg(q) {TRAIL(30)} end) as mean_30,
    R(case when count(q) {TRAIL(120)} >= 7 then avg(q) {TRAIL(120)} end) as mean_120 from v_fill""", GRID)
def _(t):
    g = flow_grid(t).select("site", "idx", "q")
    d = WN.trailing_rows_mean(g, ["site"], "idx", "q", {"mean_30": 30, "mean_120": 120}, 7)
    return d.select("site", "idx", *rsel("mean_30", "mean_120"))


@query("win_rolling_min", f"select site, idx, R(case when count(q) {TRAIL(30)} >= 7 then min(q) {TRAIL(30)} end) as base from v_fill", GRID)
def _(t):
    d = WN.trailing_rows_min(flow_grid(t).select("site", "idx", "q"), ["site"], "idx", "q", 30, 7, "base")
    return d.select("site", "idx", r("base").alias("base"))


@query("win_cumsum", "select site, day, R(sum(q * conc * 0.0027) over (partition by site order by day), 2) as cum_load from v_flow")
def _(t):
    from freshet.operators.loads import rate

    d = t.flow.withColumn("load", F.coalesce(rate("conc", "q"), F.lit(0.0)))
    d = ordered(d, ["site"], ["day"], F.floor(micros("day") / F.lit(365 * 86_400_000_000)), running={"cum": F.col("load")})
    return d.select("site", "day", r("cum", 2).alias("cum_load"))


@query("win_ecdf", f"select site, R(r2) as r2, R(row_number() over (order by r2, site) / count(*) over ()::double) as ecdf from (select site, {R2()} as r2 from v_pred group by site)")
def _(t):
    s = MT.site_skill(t.pred, ["site"], "y", "p", ["r2"]).where("r2 is not null")
    d = ordered(s, [], ["r2", "site"], value_block("r2"), number="i", total="n")
    return d.select("site", *rsel("r2"), r(F.col("i") / F.col("n")).alias("ecdf"))


@query("win_halves", f"""select site, R({R2()} filter (first)) as first_r2, R({R2()} filter (not first)) as second_r2 from v_pred
    join (select oid, row_number() over (partition by site order by time, oid) <= count(*) over (partition by site) // 2 as first,
      count(*) over (partition by site) as n from v_pred) using (oid) where n >= 6 group by site""".replace(
    f"{R2()} filter (first)", "(1 - sum((y - p) * (y - p)) filter (first) / (var_pop(y) filter (first) * count(y) filter (first)))").replace(
    f"{R2()} filter (not first)", "(1 - sum((y - p) * (y - p)) filter (not first) / (var_pop(y) filter (not first) * count(y) filter (not first)))"))
def _(t):
    d = ordered(t.pred.select("site", "oid", "time", "y", "p"), ["site"], ["time", "oid"], F.floor(micros("time") / F.lit(90 * 86_400_000_000)), number="rn", total="n")
    d = d.where("n >= 6").withColumn("half", F.when(F.col("rn") <= F.floor(F.col("n") / 2), "first").otherwise("second"))
    s = MT.site_skill(d, ["site", "half"], "y", "p", ["nse"])
    return s.groupBy("site").agg(*[r(F.max(F.when(F.col("half") == h, F.col("nse")))).alias(f"{h}_r2") for h in ("first", "second")]).where(
        "first_r2 is not null and second_r2 is not null")


SESS = {"v_sess": """select *, sum(case when time - pt > interval 40 day then 1 else 0 end) over (partition by site order by time, oid)::bigint as session
    from (select *, lag(time) over (partition by site order by time, oid) as pt from v_pred)"""}
GAP, SLICE = 40 * 86_400, 365 * 86_400


@query("win_sessionize", "select oid, site, session from v_sess", SESS)
def _(t):
    return WN.sessionize(t.pred, ["site"], "time", "oid", GAP, SLICE).select("oid", "site", "session")


def _poly(c, x):
    s = f"({c[0]})"
    for k in c[1:]:
        s = f"({s} * {x} + ({k}))"
    return s


def PROBIT(p):
    mid = f"({_poly(SP.PROBIT_A, f'(({p} - 0.5) * ({p} - 0.5))')} * ({p} - 0.5) / {_poly(SP.PROBIT_B, f'(({p} - 0.5) * ({p} - 0.5))')})"
    tail = lambda s: f"({_poly(SP.PROBIT_C, f'sqrt(-2 * ln({s}))')} / {_poly(SP.PROBIT_D, f'sqrt(-2 * ln({s}))')})"
    return f"(case when {p} < {SP.PROBIT_TAIL} then {tail(p)} when {p} > {1 - SP.PROBIT_TAIL} then -{tail(f'(1 - {p})')} else {mid} end)"


@query("win_qq", f"select oid, R(resid) as resid, R({PROBIT('u')}) as theoretical from (select oid, resid, (i - 0.5::double) / n as u from "
       "(select oid, ln(1 + y) - ln(1 + p) as resid, row_number() over (order by R(ln(1 + y) - ln(1 + p), 9), oid) as i, count(*) over () as n from v_pred))")
def _(t):
    d = t.pred.select("oid", (F.log1p("y") - F.log1p("p")).alias("resid"))
    d = ordered(d.withColumn("key", r("resid", 9)), [], ["key", "oid"], value_block("key"), number="i", total="n")
    return d.select("oid", r("resid").alias("resid"), r(SP.probit((F.col("i") - 0.5) / F.col("n"))).alias("theoretical"))


@query("win_elapsed_norm", """select oid, R(case when count(*) over w > 1 then (row_number() over (partition by site, session order by time, oid) - 1)::double / (count(*) over w - 1) else 0 end) as progress
    from v_sess window w as (partition by site, session)""", SESS)
def _(t):
    s = WN.sessionize(t.pred.select("oid", "site", "time"), ["site"], "time", "oid", GAP, SLICE)
    return WN.progress(s, ["site", "session"], "time", "oid", SLICE).select("oid", r("progress").alias("progress"))
