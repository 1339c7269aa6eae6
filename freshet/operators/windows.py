"""Window features of sensor and weather series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.basics import micros, ratio
from freshet.operators.blocks import ordered
from freshet.operators.matching import trailing_mean, window_stats


def hydrograph(
    samples: DataFrame, flow: DataFrame, site: str, keys: list[str], s_time: str, half_s: float,
    lookback_days: dict[str, int], min_points: int = 10,
) -> DataFrame:
    """Flow slope around each sample, rising flag and trailing means.

    ``flow`` is (site, time, value). Sites with fewer than ``min_points`` readings give NULL.
    """
    rich = flow.where("value is not null").groupBy(site).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points).select(site)
    q = flow.join(rich, site, "left_semi")
    s = window_stats(samples, q, [site], keys, s_time, "time", "value", half_s, short_slope=None)
    out = samples.join(s.select(*keys, F.col("window_slope").alias("flow_slope")), keys, "left")
    out = out.withColumn("rising", (F.col("flow_slope") > 0).cast("double"))
    for name, days in lookback_days.items():
        out = out.join(trailing_mean(samples, q, [site], keys, s_time, "time", "value", days, name), keys, "left")
    return out


def flow_ratio(flow: str, mean: str) -> Column:
    return F.when(F.col(mean) > 0, ratio(flow, mean))


def rain_features(daily: DataFrame, site: str, day: str, rain: str, wet: float = 1.0) -> DataFrame:
    """Antecedent rain sums and rows since the last wet day.

    One row per site and calendar day, so a window by site is bounded by the calendar.
    """
    w = W.partitionBy(site).orderBy(day)
    back = lambda n: F.sum(rain).over(w.rowsBetween(-n, -1))
    rn = F.row_number().over(w)
    d = daily.withColumns({
        "rain_1d": F.lag(rain).over(w), "rain_2d": back(2), "rain_7d": back(7), "rain_30d": back(30), "_rn": rn,
    })
    last = F.last(F.when(F.col(rain) > wet, F.col("_rn")), True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("days_since_rain", (F.col("_rn") - last).cast("double")).drop("_rn")


MIN_SLICE_ROWS = 4096


def halo(df: DataFrame, by: list[str], idx: str, before: int, after: int) -> tuple[DataFrame, W]:
    """Copy each row to the slices whose core needs it; returns the frame and its window.

    ``idx`` counts rows without holes. Slices are at least eight times as long as the
    reach, so few rows are copied, and a long series still spreads over its slices.
    """
    size = max(8 * max(before, after), MIN_SLICE_ROWS)
    s = F.lit(size)
    d = df.withColumn("_hb", F.explode(F.sequence(F.floor((F.col(idx) - after) / s), F.floor((F.col(idx) + before) / s))))
    d = d.withColumn("_core", F.col("_hb") == F.floor(F.col(idx) / s))
    return d, W.partitionBy(*by, "_hb").orderBy(idx)


def core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_hb", "_core")


def centered_stats(df: DataFrame, by: list[str], idx: str, col: str, before: int = 4, after: int = 3) -> DataFrame:
    """Centred mean, min, max, range and sample std (0 below two values)."""
    d, w = halo(df, by, idx, before, after)
    f = w.rowsBetween(-before, after)
    d = d.withColumns({
        "c_mean": F.avg(col).over(f), "c_min": F.min(col).over(f), "c_max": F.max(col).over(f),
        "c_std": F.coalesce(F.stddev_samp(col).over(f), F.lit(0.0)),
    })
    return core(d.withColumn("c_range", F.col("c_max") - F.col("c_min")))


def fixed_slope(df: DataFrame, by: list[str], idx: str, col: str, width: int, out: str) -> DataFrame:
    """Least-squares slope per step over ``width`` rows; only full windows that also have
    a row behind them."""
    half = width // 2
    d, w = halo(df, by, idx, half, half)
    f = w.rowsBetween(-half, width - half - 1)
    steps = [i - (width - 1) / 2 for i in range(width)]
    norm = sum(x * x for x in steps)
    total = sum((F.lag(col, half - i).over(w) * F.lit(x / norm) for i, x in enumerate(steps)), F.lit(0.0))
    full = (F.count(col).over(f) == width) & F.lead(F.lit(1), half).over(w).isNotNull()
    return core(d.withColumn(out, F.when(full, total)))


def trailing_rows_mean(
    df: DataFrame, by: list[str], idx: str, col: str, rows: int | dict[str, int], min_count: int, out: str | None = None,
) -> DataFrame:
    """Trailing mean from running sums inside a slice: constant work per row.

    ``rows`` may map output names to lengths: all of them then share one exchange and one sort.
    """
    spans = rows if isinstance(rows, dict) else {out: rows}
    d, w = halo(df, by, idx, max(spans.values()), 0)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum(F.coalesce(F.col(col), F.lit(0.0))).over(run)).withColumn("_n", F.count(col).over(run))
    for name, k in spans.items():
        s = F.col("_s") - F.coalesce(F.lag("_s", k).over(w), F.lit(0.0))
        n = F.col("_n") - F.coalesce(F.lag("_n", k).over(w), F.lit(0))
        d = d.withColumn("_ts", s).withColumn("_tn", n)
        d = d.withColumn(name, F.when(F.col("_tn") >= min_count, F.col("_ts") / F.col("_tn")))
    return core(d).drop("_s", "_n", "_ts", "_tn")


def rolling_min_columns(d: DataFrame, by: list[str], w: W, idx: str, col: str, rows: int, min_count: int, out: str) -> DataFrame:
    """Trailing minimum on a halo frame: minima of 1, 2, 4, ... rows, the last of them taken at both ends of the frame.

    All look back in the frame's own order, so a slice is sorted once and no frame is read row by row.
    """
    d = d.withColumn("_m", F.col(col)).withColumn("_cnt", F.count(col).over(w.rowsBetween(W.unboundedPreceding, 0)))
    span = 1
    while span < rows:
        step = min(span, rows - span)
        d = d.withColumn("_m", F.least("_m", F.lag("_m", step).over(w)))
        span += step
    n = F.col("_cnt") - F.coalesce(F.lag("_cnt", rows).over(w), F.lit(0))
    return d.withColumn("_k", n).withColumn(out, F.when(F.col("_k") >= min_count, F.col("_m"))).drop("_cnt", "_m", "_k")


def trailing_rows_min(df: DataFrame, by: list[str], idx: str, col: str, rows: int, min_count: int, out: str) -> DataFrame:
    d, w = halo(df, by, idx, rows, 0)
    return core(rolling_min_columns(d, by, w, idx, col, rows, min_count, out))


def sessionize(df: DataFrame, by: list[str], t: str, uid: str, gap_s: float, slice_s: float, out: str = "session") -> DataFrame:
    """Session number per entity (0, 1, ...): a new one after a pause longer than gap_s.

    Breaks are counted inside time slices; the break between slices and the offset come
    from the list of slices.
    """
    gap = int(gap_s * 1e6)
    d = df.withColumn("_t", micros(t)).withColumn("_blk", F.floor(F.col("_t") / F.lit(int(slice_s * 1e6))))
    w = W.partitionBy(*by, "_blk").orderBy("_t", uid)
    d = d.withColumn("_brk", F.coalesce(F.col("_t") - F.lag("_t").over(w) > gap, F.lit(False)).cast("long"))
    d = d.withColumn("_in", F.sum("_brk").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = d.groupBy(*by, "_blk").agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"), F.sum("_brk").alias("_n"))
    ws = W.partitionBy(*by).orderBy("_blk")
    s = s.withColumn("_lead", F.coalesce(F.col("_a") - F.lag("_z").over(ws) > gap, F.lit(False)).cast("long"))
    off = F.coalesce(F.sum(F.col("_n") + F.col("_lead")).over(ws.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.select(*by, "_blk", (off + F.col("_lead")).alias("_off"))
    j = d.join(s, [*by, "_blk"], "left")
    return j.select(*df.columns, (F.col("_in") + F.col("_off")).alias(out))


def progress(df: DataFrame, by: list[str], t: str, uid: str, slice_s: float, out: str = "progress") -> DataFrame:
    """0 to 1 along the rows of a group."""
    blk = F.floor(micros(t) / F.lit(int(slice_s * 1e6)))
    d = ordered(df, by, [t, uid], blk, number="_rn", total="_n")
    return d.withColumn(out, F.when(F.col("_n") > 1, (F.col("_rn") - 1) / (F.col("_n") - 1)).otherwise(0.0)).drop("_rn", "_n")
