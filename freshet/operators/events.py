"""Storm events from continuous flow and from sampled series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions.basics import micros, settle
from freshet.operators.blocks import ordered
from freshet.operators.windows import core, halo, rolling_min_columns, sessionize


def detect(
    flow: DataFrame, site: str, t: str, q: str, rows: int = 672, min_count: int = 96, rise: float = 1.5,
    min_h: float = 6, sep_h: float = 24, slice_s: float = 30 * 86_400,
) -> DataFrame:
    """Periods of flow above ``rise`` times the trailing minimum.

    An event runs from its first row above the threshold to the first row that is not
    (the last row of the record if it stays open), lasts at least ``min_h`` hours, and
    is merged with the one before when less than ``sep_h`` hours lie between them.
    Only rows where the state flips go on; the full series is windowed once.
    """
    blk = F.floor(micros(t) / F.lit(int(slice_s * 1e6)))
    d = flow.where(F.col(q).isNotNull()).select(site, F.col(t).alias("_time"), micros(t).alias("_t"), F.col(q).alias("_q"))
    d = ordered(d, [site], ["_t"], F.floor(F.col("_t") / F.lit(int(slice_s * 1e6))), number="_rn", total="_n").where(F.col("_n") >= rows)
    h, w = halo(d, [site], "_rn", rows + 1, 0)
    h = rolling_min_columns(h, [site], w, "_rn", "_q", rows, min_count, "_base")
    h = h.withColumn("_up", F.coalesce(F.col("_q") > F.col("_base") * rise, F.lit(False)))
    h = h.withColumn("_was", F.coalesce(F.lag("_up").over(w), F.lit(False)))
    flips = core(h).where((F.col("_up") != F.col("_was")) | (F.col("_up") & (F.col("_rn") == F.col("_n"))))
    edge = settle(flips.select(
        site, "_t", "_time", "_base", (F.col("_up") & ~F.col("_was")).alias("_start"),
        F.when(~F.col("_up") | (F.col("_rn") == F.col("_n")), F.col("_time")).alias("_stop"),
    ))  # few rows, which every step below reads several times
    e_blk = F.floor(F.col("_t") / F.lit(int(12 * slice_s * 1e6)))
    ev = ordered(edge, [site], ["_t"], e_blk, follow={"end": F.col("_stop")}).where("_start")
    ev = ev.select(site, "_t", F.col("_time").alias("start"), F.coalesce("end", "_stop").alias("end"), F.col("_base").alias("baseflow"))
    hours = (micros("end") - micros("start")) / F.lit(3.6e9)
    ev = ev.withColumn("_h", hours).where((F.col("_h") >= min_h) & F.col("_h").isNotNull())
    # the end of the merged event so far is the end of the event before
    ev = ordered(ev, [site], ["_t"], F.floor(F.col("_t") / F.lit(int(12 * slice_s * 1e6))), prev={"_pe": F.col("end")})
    fresh = F.col("_pe").isNull() | ((micros("start") - micros("_pe")) / F.lit(3.6e9) >= sep_h)
    ev = ordered(ev.withColumn("_new", fresh.cast("long")), [site], ["_t"], F.floor(F.col("_t") / F.lit(int(12 * slice_s * 1e6))), running={"event": F.col("_new")})
    m = ev.groupBy(site, "event").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("baseflow", "_t").alias("baseflow"))
    peak = peaks(m, flow, site, t, q, slice_s)
    return m.join(peak, [site, "event"], "left").withColumn("duration_h", (micros("end") - micros("start")) / F.lit(3.6e9))


def peaks(events: DataFrame, flow: DataFrame, site: str, t: str, q: str, slice_s: float) -> DataFrame:
    us = F.lit(int(slice_s * 1e6))
    e = events.select(site, "event", micros("start").alias("_a"), micros("end").alias("_z"))
    e = e.withColumn("_sl", F.explode(F.sequence(F.floor(F.col("_a") / us), F.floor(F.col("_z") / us))))
    r = flow.select(site, micros(t).alias("_t"), F.col(q).alias("_q")).withColumn("_sl", F.floor(F.col("_t") / us))
    return e.join(r, [site, "_sl"]).where(F.col("_t").between(F.col("_a"), F.col("_z"))).groupBy(site, "event").agg(F.max("_q").alias("peak"))


def event_loads(events: DataFrame, daily: DataFrame, site: str, day: str, ref: str, methods: list[str]) -> DataFrame:
    """Load sums over the calendar days of each event and the error of each method."""
    e = events.select(site, "event", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias(day))
    z = lambda x: F.coalesce(F.sum(x), F.lit(0.0)).alias(x)
    g = e.join(daily, [site, day], "left").groupBy(site, "event").agg(*[z(x) for x in [ref, *methods]])
    err = {f"pct_{m}": F.when(F.col(ref) > 0.1, 100 * (F.col(m) - F.col(ref)) / F.nullif(F.col(ref), F.lit(0.0))) for m in methods}
    return events.join(g.withColumns(err), [site, "event"])


def sample_storms(df: DataFrame, site: str, t: str, uid: str, y: str, gap_s: float, slice_s: float, min_n: int = 8, min_ratio: float = 3.0, flow: str | None = None, flow_ratio: float = 2.0) -> DataFrame:
    """Sampling sessions with enough rows and range; one row per storm."""
    s = sessionize(df, [site], t, uid, gap_s, slice_s)
    aggs = [F.count("*").alias("n"), F.max(y).alias("peak"), F.min(y).alias("low"), F.min(t).alias("start"), F.max(t).alias("end")]
    if flow:
        aggs += [F.max(flow).alias("_qh"), F.min(flow).alias("_ql")]
    g = s.groupBy(site, "session").agg(*aggs)
    g = g.where((F.col("n") >= min_n) & (F.col("peak") / F.greatest("low", F.lit(1.0)) >= min_ratio))
    if flow:
        g = g.where(F.col("_qh") / F.greatest("_ql", F.lit(1.0)) >= flow_ratio).drop("_qh", "_ql")
    return g


def best_per_site(storms: DataFrame, site: str, n: int) -> DataFrame:
    """Largest storm of each site, then the n sites with the largest ones."""
    rest = [x for x in storms.columns if x != site]
    top = storms.groupBy(site).agg(F.max(F.struct(F.col("peak").alias("_p"), (-F.col("session")).alias("_s"), *rest)).alias("_m"))
    return top.select(site, *[F.col("_m")[x].alias(x) for x in rest]).orderBy(F.desc("peak"), site).limit(n)
