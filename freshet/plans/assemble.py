"""The paired dataset: lab samples next to what the sensors saw, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions.basics import micros, settle
from freshet.operators import joins, matching as M, qc


def attach_sensors(hits: DataFrame, series: DataFrame, site: str, keys: list[str], s_time: str, sensors: dict[str, str], tol_s: float) -> DataFrame:
    """One bracketed value per extra sensor, matched in a single pass keyed (site, pcode)."""
    codes = F.array(*[F.lit(x) for x in sensors])
    s = hits.select(*keys).withColumn("pcode", F.explode(codes))
    m = M.bracket(s, series, [site, "pcode"], keys, s_time, "time", "value", tol_s)
    wide = m.groupBy(*keys).agg(*[F.max(F.when(F.col("pcode") == k, F.col("sensor_instant"))).alias(v) for k, v in sensors.items()])
    return hits.join(wide, keys, "left")


def last_calibration(pairs: DataFrame, visits: DataFrame, site: str, s_time: str, sid: str, self_s: float, slice_s: float) -> DataFrame:
    """Latest visit's offset at each sample; a hand-held pair does not see its own visit.

    Skipping visits within ``self_s`` before the sample is the same as looking back
    from a moment just over ``self_s`` earlier.
    """
    shift = F.when(F.col("source") == "discrete", F.lit(int(self_s * 1e6) + 1)).otherwise(F.lit(0))
    at = F.timestamp_micros(micros(s_time) - shift)
    d = M.last_known(pairs.withColumn("_asof", at), visits, [site], "_asof", "visit_time", ["offset", "family"], sid, slice_s)
    days = (micros(s_time) - micros("visit_time")) / F.lit(86_400e6)
    return d.drop("_asof").withColumn("days_since_visit", days).withColumn("family", F.coalesce("family", F.lit("unknown")))


def field_pairs(lab: DataFrame, taken: DataFrame, field: DataFrame, site: str, keys: list[str], s_time: str, carry: list[str], tol_s: float) -> DataFrame:
    """Samples without a sensor match, paired with the nearest hand-held reading."""
    rest = lab.join(taken.select(site, s_time), [site, s_time], "left_anti")
    return M.nearest(rest, field, [site], keys, s_time, "field_time", carry, tol_s)


def paired_dataset(
    lab: DataFrame, obs: DataFrame, field: DataFrame, visits: DataFrame, main: str, sensors: dict[str, str],
    tol_s: float, half_s: float, field_tol_s: float, self_s: float, slice_s: float = 30 * 86_400,
) -> DataFrame:
    """Sensor pairs, hand-held pairs for the rest, extra sensors, last calibration."""
    series = qc.clean_series(obs, ["site", "pcode"], "time", "event_id")
    keys = ["site", "pos", "sample_time"]
    s = lab.select("site", "pos", F.col("time").alias("sample_time"), F.col("value").alias("lab_value"), "is_nondetect", "method")
    hit = M.align_wide(s, series, "site", [*keys, "lab_value"], "sample_time", main, sensors, tol_s, half_s)
    hit = settle(hit.withColumn("source", F.lit("continuous")))  # read again to find the unmatched samples
    f = field.select("site", F.col("time").alias("field_time"), F.col("value").alias("sensor_instant"))
    extra = field_pairs(s, hit, f, "site", [*keys, "lab_value"], "sample_time", ["sensor_instant"], field_tol_s)
    extra = extra.withColumnRenamed("gap_s", "match_gap_seconds").withColumn("window_count", F.lit(0).cast("long")).withColumn("source", F.lit("discrete"))
    both = hit.unionByName(extra, allowMissingColumns=True)
    meta = s.select(*keys, "is_nondetect", "method")
    return last_calibration(both.join(meta, keys, "left"), visits, "site", "sample_time", "pos", self_s, slice_s)


def paired_parameter(
    lab: DataFrame, obs: DataFrame, main: str, sensors: dict[str, str], tol_s: float, half_s: float, min_pairable: int, share: float = 0.5
) -> DataFrame:
    """The same for one analyte: overlap-gated sites, nearest extra sensors, censoring filter."""
    series = qc.clean_series(obs, ["site", "pcode"], "time", "event_id")
    span = joins.record_span(obs.where(F.col("pcode") == main), ["site"], "time", "rec")
    ok = joins.counts_in_record(lab, span, "site", "time", "rec").where(F.col("n_inside") >= min_pairable).select("site")
    keys = ["site", "pos", "sample_time"]
    s = lab.join(ok, "site", "left_semi").select("site", "pos", F.col("time").alias("sample_time"), F.col("value").alias("lab_value"), "is_nondetect")
    hit = settle(M.align_wide(s, series, "site", [*keys, "lab_value"], "sample_time", main, {}, tol_s, half_s))
    codes = F.array(*[F.lit(x) for x in sensors])
    near = M.nearest(
        hit.select(*keys).withColumn("pcode", F.explode(codes)), series.select("site", "pcode", F.col("time").alias("r_time"), "value"),
        ["site", "pcode"], [*keys, "pcode"], "sample_time", "r_time", ["value"], tol_s,
    )
    wide = near.groupBy(*keys).agg(*[F.max(F.when(F.col("pcode") == k, F.col("value"))).alias(v) for k, v in sensors.items()])
    d = hit.join(wide, keys, "left").join(s.select(*keys, "is_nondetect"), keys, "left").withColumn("target", F.log1p("lab_value"))
    return qc.drop_sites(d, qc.high_censoring(d, "site", "is_nondetect", share))


