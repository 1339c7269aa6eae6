"""Matching sparse samples to dense readings in time.

Every match within a tolerance is an equi-join on (entity, time slice) plus the exact
time test. The sparse side is copied to the slices its window touches (two at most),
so a long series is spread over its slices and no per-entity pair list is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.basics import micros
from freshet.operators.blocks import ordered


def band_pairs(
    samples: DataFrame,
    readings: DataFrame,
    by: list[str],
    s_time: str,
    r_time: str,
    before_s: float,
    after_s: float,
    how: str = "inner",
) -> DataFrame:
    """Pairs with r_time in [s_time - before, s_time + after], both ends included.

    Adds ``_dt``: reading minus sample in microseconds. Reading columns must not clash
    with sample columns except ``by``.
    """
    b, a = int(before_s * 1e6), int(after_s * 1e6)
    width = max(b + a, 1)
    s = samples.withColumn("_st", micros(s_time)).withColumn(
        "_slice",
        F.explode(
            F.sequence(F.floor((F.col("_st") - b) / F.lit(width)), F.floor((F.col("_st") + a) / F.lit(width)))
        ),
    )
    rd = readings.withColumn("_rt", micros(r_time)).withColumn("_slice", F.floor(F.col("_rt") / F.lit(width)))
    near = F.col("_rt").between(F.col("_st") - b, F.col("_st") + a)
    return (
        s.join(rd, [*by, "_slice"], "inner")
        .where(near)
        .withColumn("_dt", F.col("_rt") - F.col("_st"))
        .drop("_slice", "_st")
    )


def bracket(
    samples: DataFrame,
    readings: DataFrame,
    by: list[str],
    sid: list[str],
    s_time: str,
    r_time: str,
    r_value: str,
    tol_s: float,
    out: str = "sensor_instant",
    gap: str = "match_gap_seconds",
    keep: list[str] | None = None,
) -> DataFrame:
    """Linear interpolation between the flanking readings, one side alone if need be.

    The earlier flank lies strictly before the sample, the later one at or after it.
    With both flanks the reported gap is the larger one. Samples without a flank in
    the tolerance are dropped. ``keep`` lists sample columns carried along.
    """
    keep = keep or []
    rd = readings.where(F.col(r_value).isNotNull()).select(*by, F.col(r_time).alias("_t"), F.col(r_value).alias("_v"))
    p = band_pairs(samples.select(*dict.fromkeys([*by, *sid, s_time, *keep])), rd, by, s_time, "_t", tol_s, tol_s)
    point = F.struct(F.col("_dt").alias("d"), F.col("_v").alias("v"))
    keys = list(dict.fromkeys([*by, *sid, s_time, *keep]))
    g = p.groupBy(*keys).agg(
        F.max(F.when(F.col("_dt") < 0, point)).alias("_b"),
        F.min(F.when(F.col("_dt") >= 0, point)).alias("_a"),
    )
    value, gap_s = _interpolated(F.col("_b"), F.col("_a"))
    return g.select(*keys, value.alias(out), gap_s.alias(gap))


def _interpolated(b: Column, a: Column) -> tuple[Column, Column]:
    """Value and reported gap from the flanking points struct<d: micros, v>."""
    gb, ga = -b["d"] / F.lit(1e6), a["d"] / F.lit(1e6)
    line = b["v"] + (a["v"] - b["v"]) * (gb / (gb + ga))
    gap = F.when(b.isNotNull() & a.isNotNull(), F.greatest(gb, ga)).otherwise(F.coalesce(gb, ga))
    return F.coalesce(line, b["v"], a["v"]), gap


def nearest(
    samples: DataFrame,
    readings: DataFrame,
    by: list[str],
    keys: list[str],
    s_time: str,
    r_time: str,
    carry: list[str],
    tol_s: float,
) -> DataFrame:
    """Nearest reading within the tolerance (earlier one on ties); unmatched dropped."""
    rd = readings.select(*by, r_time, *[x for x in carry if x not in (*by, r_time)])
    p = band_pairs(samples, rd, by, s_time, r_time, tol_s, tol_s)
    best = F.min(
        F.struct(F.abs("_dt").alias("g"), F.col("_dt").alias("d"), *[F.col(x) for x in carry])
    ).alias("_m")
    g = p.groupBy(*keys).agg(best)
    return g.select(*keys, *[F.col("_m")[x].alias(x) for x in carry], (F.col("_m")["g"] / F.lit(1e6)).alias("gap_s"))


def last_known(
    samples: DataFrame,
    visits: DataFrame,
    by: list[str],
    s_time: str,
    v_time: str,
    carry: list[str],
    sid: str,
    slice_s: float,
    prefix: str = "",
) -> DataFrame:
    """Latest visit at or before each sample, however long ago (NULL if none); of several at one time the greatest by ``carry``."""
    payload = F.struct(F.col(v_time).alias("t"), *carry)
    a = samples.select(
        *by,
        micros(s_time).alias("_t"),
        F.lit(1).alias("_kind"),
        F.col(sid).cast("long").alias("_id"),
        F.struct(*samples.columns).alias("_s"),
    )
    b = visits.select(*by, micros(v_time).alias("_t"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_id"), payload.alias("_v"))
    u = a.unionByName(b, allowMissingColumns=True)
    block = F.floor(F.col("_t") / F.lit(int(slice_s * 1e6)))
    o = ordered(u, by, ["_t", "_kind", "_id", "_v"], block, last={"_hit": F.col("_v")})
    return o.where(F.col("_kind") == 1).select(
        "_s.*", F.col("_hit.t").alias(prefix + v_time), *[F.col("_hit")[x].alias(prefix + x) for x in carry]
    )


def _window_aggs(cond: Column | None = None) -> list[Column]:
    """Window statistics over pair rows that carry ``_v``, ``_rt`` and first time ``_t0``."""
    on = lambda x: x if cond is None else F.when(cond, x)
    v = on(F.col("_v"))
    x = on(F.floor((F.col("_rt") - F.col("_t0")) / F.lit(1e6)).cast("double"))
    return [
        F.avg(v).alias("window_mean"), F.min(v).alias("window_min"), F.max(v).alias("window_max"),
        F.stddev_pop(v).alias("window_std"), F.count(v).alias("window_count"),
        F.var_pop(x).alias("_vx"), F.covar_pop(x, v).alias("_cxy"),
    ]


def _slope(short: Column) -> Column:
    """OLS slope from the sums; ``short`` is what fewer than two readings give, no spread gives 0."""
    return (
        F.when(F.col("window_count") < 2, short)
        .when(F.col("_vx") == 0, F.lit(0.0))
        .otherwise(F.col("_cxy") / F.nullif(F.col("_vx"), F.lit(0.0)))
    )


def _first_time(pairs: DataFrame, keys: list[str], cond: Column | None = None) -> DataFrame:
    """First reading time of each sample's window; a sample's own pairs are few, so this is
    a small window, and the aggregate after it reuses its partitioning."""
    t = F.col("_rt") if cond is None else F.when(cond, F.col("_rt"))
    return pairs.withColumn("_t0", F.min(t).over(W.partitionBy(*keys)))


def window_stats(
    samples: DataFrame,
    readings: DataFrame,
    by: list[str],
    keys: list[str],
    s_time: str,
    r_time: str,
    r_value: str,
    half_s: float,
    short_slope: float | None = 0.0,
) -> DataFrame:
    """Mean, min, max, population std, range, count and OLS slope in +-half_s.

    Slope time is whole elapsed seconds since the first reading of the window; no
    spread gives 0, fewer than two readings give ``short_slope``.
    """
    rd = readings.where(F.col(r_value).isNotNull()).select(*by, F.col(r_time).alias("_t"), F.col(r_value).alias("_v"))
    p = _first_time(band_pairs(samples.select(*keys), rd, by, s_time, "_t", half_s, half_s), keys)
    return p.groupBy(*keys).agg(*_window_aggs()).select(
        *keys, "window_mean", "window_min", "window_max", "window_std",
        (F.col("window_max") - F.col("window_min")).alias("window_range"), "window_count",
        _slope(F.lit(short_slope).cast("double")).alias("window_slope"),
    )


def align_wide(
    samples: DataFrame,
    series: DataFrame,
    site: str,
    keys: list[str],
    s_time: str,
    main: str,
    sensors: dict[str, str],
    tol_s: float,
    half_s: float,
) -> DataFrame:
    """Everything the sensors saw around each sample, from one pass over the series.

    ``series`` holds all parameters as (site, pcode, time, value). The main parameter
    gives the bracketed value, its gap and the window statistics; every other one its
    bracketed value. Samples without a main match are dropped.
    """
    codes = F.array(*[F.lit(x) for x in [main, *sensors]])
    s = samples.select(*keys).withColumn("pcode", F.explode(codes))
    rd = series.where(F.col("value").isNotNull()).select(site, "pcode", F.col("time").alias("_t"), F.col("value").alias("_v"))
    reach = max(tol_s, half_s)
    is_main, tol, half = F.col("pcode") == main, int(tol_s * 1e6), int(half_s * 1e6)
    p = band_pairs(s, rd, [site, "pcode"], s_time, "_t", reach, reach).where(is_main | (F.abs("_dt") <= tol))
    inside = is_main & (F.abs("_dt") <= half)
    p = _first_time(p, keys, inside)
    point = F.struct(F.col("_dt").alias("d"), F.col("_v").alias("v"))
    aggs = _window_aggs(inside)
    names = [main, *sensors]
    for i, code in enumerate(names):
        near = (F.col("pcode") == code) & (F.abs("_dt") <= tol)
        aggs += [
            F.max(F.when(near & (F.col("_dt") < 0), point)).alias(f"_b{i}"),
            F.min(F.when(near & (F.col("_dt") >= 0), point)).alias(f"_a{i}"),
        ]
    g = p.groupBy(*keys).agg(*aggs).where(F.col("_b0").isNotNull() | F.col("_a0").isNotNull())
    value, gap = zip(*[_interpolated(F.col(f"_b{i}"), F.col(f"_a{i}")) for i in range(len(names))])
    return g.select(
        *keys, value[0].alias("sensor_instant"), gap[0].alias("match_gap_seconds"),
        "window_mean", "window_min", "window_max", "window_std",
        (F.col("window_max") - F.col("window_min")).alias("window_range"), "window_count",
        F.when(F.col("window_count") > 0, _slope(F.lit(0.0))).alias("window_slope"),
        *[value[i + 1].alias(n) for i, n in enumerate(sensors.values())],
    )


def trailing_mean(
    samples: DataFrame,
    readings: DataFrame,
    by: list[str],
    keys: list[str],
    s_time: str,
    r_time: str,
    r_value: str,
    days: int,
    out: str,
    slice_s: int = 86_400,
) -> DataFrame:
    """Mean of readings in [t - days, t].

    Whole slices inside the window come from per-slice sums; only the two edge slices
    read single readings, so the cost does not grow with readings per window.
    """
    w = int(slice_s * 1e6)
    span = int(days * 86_400 * 1e6)
    rd = readings.where(F.col(r_value).isNotNull()).select(
        *by, micros(r_time).alias("_rt"), F.col(r_value).alias("_v")
    ).withColumn("_slice", F.floor(F.col("_rt") / F.lit(w)))
    s = samples.select(*keys).withColumn("_st", micros(s_time))
    lo, hi = F.floor((F.col("_st") - span) / F.lit(w)), F.floor(F.col("_st") / F.lit(w))
    s = s.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_slice", F.explode(F.sequence("_lo", "_hi")))
    inside = (F.col("_slice") > F.col("_lo")) & (F.col("_slice") < F.col("_hi"))
    per = rd.groupBy(*by, "_slice").agg(F.sum("_v").alias("_sv"), F.count("_v").alias("_nv"))
    mid = s.where(inside).join(per, [*by, "_slice"]).select(*keys, "_sv", "_nv")
    edge = (
        s.where(~inside)
        .join(rd, [*by, "_slice"])
        .where(F.col("_rt").between(F.col("_st") - span, F.col("_st")))
        .select(*keys, F.col("_v").alias("_sv"), F.lit(1).cast("long").alias("_nv"))
    )
    g = mid.unionByName(edge).groupBy(*keys).agg((F.sum("_sv") / F.sum("_nv")).alias(out), F.sum("_nv").alias("_n"))
    return g.drop("_n")
