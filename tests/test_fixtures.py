"""Handmade rows with the outcome the operators must give."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.functions import normalize as N, transforms as X
from freshet.operators import dedup, matching as M, metrics as MT, qc
from freshet.sources.lab import parse_lab

T0 = dt.datetime(2024, 1, 1)
BY = ["site", "pcode"]


def series(spark, rows):
    """rows of (minutes after T0, value, approval, qualifier)"""
    data = [(1, "t", T0 + dt.timedelta(minutes=m), float(v) if v is not None else None, a, q, i) for i, (m, v, a, q) in enumerate(rows)]
    return spark.createDataFrame(data, "site long, pcode string, time timestamp_ntz, value double, approval_status string, qualifier string, event_id long")


def kept(spark, rows):
    return sorted(r.value for r in qc.clean_series(series(spark, rows), BY, "time", "event_id").collect())


def test_approval_keeps_approved_only(spark):
    assert kept(spark, [(0, 10, "Approved", ""), (15, 11, "Provisional", "")]) == [10.0]
    assert kept(spark, [(0, 1, "A", None), (15, 2, "P", None), (30, 3, "A, R", None), (45, 4, "A, >", None)]) == [1.0, 3.0, 4.0]


@pytest.mark.parametrize("q,keep", [("Ice", False), ("Eqp", False), ("Fld", True), (None, True), ("", True), ("Fld,Ice", False), ("['ICE' 'EQUIP']", False), ("e", True)])
def test_qualifier(spark, q, keep):
    assert (kept(spark, [(0, 5, "Approved", q)]) == [5.0]) is keep


def test_stats_row(spark):
    d = series(spark, [(0, 1, "Approved", ""), (15, 2, "Provisional", ""), (30, 3, "Approved", "Bkw"), (45, 4, "Approved", "Fld")])
    r = qc.qc_stats(d, "site", BY, "time", "event_id").first()
    assert (r.n_original, r.n_not_approved, r.n_bad_qualifier, r.n_after_filter, r.pct_retained) == (4, 1, 1, 2, 50.0)


def test_empty_series(spark):
    assert kept(spark, []) == []


def test_value_range(spark):
    assert kept(spark, [(i * 15, v, "Approved", "") for i, v in enumerate([-5, 200000, 100000, 0, -0.005, None])]) == [-0.005, 0.0, 100000.0]


def test_ice_buffer_is_48_hours_after_the_last_flag(spark):
    rows = [(0, 1, "A", "Ice"), (15, 1, "A", "Ice"), (47 * 60, 2, "A", ""), (48 * 60 + 15, 3, "A", ""), (48 * 60 + 16, 4, "A", "")]
    assert kept(spark, rows) == [4.0]


def test_maint_buffer_is_4_hours_and_episodes_split_after_an_hour(spark):
    rows = [(0, 1, "A", "MAINT"), (90, 1, "A", "MAINT"), (60, 7, "A", ""), (329, 8, "A", ""), (331, 9, "A", "")]
    assert kept(spark, rows) == [9.0]
    assert kept(spark, [(0, 1, "A", "Mnt"), (15, 2, "A", "")]) == [2.0]  # excluded, but no buffer


def lab(spark, rows):
    schema = "site long, pos long, start_date string, start_time string, start_tz string, measure string, condition string, limit_a string, limit_b string, equipment string, org string"
    full = [(1, i, r.get("date", "2024-06-15"), r.get("time", "10:00:00"), r.get("tz", "UTC"), r.get("v", "50"), r.get("cond"), None, r.get("dl"), r.get("eq"), r.get("org", "LAB")) for i, r in enumerate(rows)]
    return parse_lab(spark.createDataFrame(full, schema), "site", ["limit_a", "limit_b"], 1.0).orderBy("time").collect()


@pytest.mark.parametrize("tz,hour", [("CST", 16), ("EST", 15), ("PST", 18), ("UTC", 10)])
def test_local_time_to_utc(spark, tz, hour):
    assert lab(spark, [{"tz": tz}])[0].time.hour == hour


@pytest.mark.parametrize("row", [{"tz": None}, {"tz": "unknown"}, {"time": None}, {"time": ""}])
def test_unusable_time_is_dropped(spark, row):
    assert lab(spark, [row]) == []


def test_nondetects(spark):
    r = lab(spark, [{"cond": "Not Detected", "dl": "4", "v": "9"}])[0]
    assert (r.value, r.is_nondetect) == (2.0, True)
    r = lab(spark, [{"cond": "Not Detected", "v": "6"}])[0]
    assert (r.value, r.is_nondetect) == (3.0, True)
    assert lab(spark, [{"v": "0"}])[0].value == 0.0
    assert lab(spark, [{"v": "100"}])[0].is_nondetect is False
    assert lab(spark, [{"cond": "Not Detected", "dl": "0"}])[0].value == 0.5  # a zero limit falls back to the default


def test_duplicates_and_conflicts(spark):
    assert len(lab(spark, [{}, {}, {}])) == 1
    assert len(lab(spark, [{}, {"time": "11:00:00"}])) == 2
    assert lab(spark, [{"v": "50"}, {"v": "75"}])[0].value == 50.0
    assert lab(spark, [{"v": "50"}, {"v": "75", "org": "USGS-X"}])[0].value == 75.0


def test_conflict_prefers_a_value_over_missing(spark):
    d = spark.createDataFrame([(1, 0, None, "USGS"), (1, 1, 5.0, "LAB"), (1, 2, 5.0, "USGS")], "site long, pos long, value double, org string")
    r = dedup.resolve_conflicts(d, ["site"], "value", "org", "pos").first()
    assert (r.pos, r.value, r.was_conflict) == (1, 5.0, False)


def aligned(spark, n, minutes):
    noon = dt.datetime(2024, 1, 1, 12)
    ser = spark.createDataFrame([(1, "t", noon + dt.timedelta(minutes=15 * i), float(i + 1)) for i in range(n)], "site long, pcode string, time timestamp_ntz, value double")
    s = spark.createDataFrame([(1, i, noon + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], "site long, pos long, sample_time timestamp_ntz")
    return M.align_wide(s, ser, "site", ["site", "pos", "sample_time"], "sample_time", "t", {}, 900, 3600).orderBy("pos").collect()


@pytest.mark.parametrize("minute,value,gap", [(30, 3.0, 900), (37, 3.4667, 480), (25, 2.6667, 600)])
def test_bracketing(spark, minute, value, gap):
    r = aligned(spark, 9, [minute])[0]
    assert r.sensor_instant == pytest.approx(value, abs=1e-4) and r.match_gap_seconds == gap


def test_outside_has_no_match(spark):
    assert aligned(spark, 3, [120]) == []


def test_window_of_a_line(spark):
    r = aligned(spark, 9, [60])[0]
    assert (r.window_count, r.window_min, r.window_max, r.window_range) == (9, 1.0, 9.0, 8.0)
    assert r.window_slope == pytest.approx(1 / 900) and r.window_std == pytest.approx(2.581988897)


def test_several_samples(spark):
    assert [r.sensor_instant for r in aligned(spark, 9, [0, 30, 60])] == [1.0, 3.0, 5.0]


def test_season_and_oxygen(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 7, 1),), (dt.datetime(2024, 12, 31),)], "t timestamp_ntz")
    s, c = X.season("t")
    a = d.select(s.alias("s"), c.alias("c")).collect()
    assert abs(a[0].c - a[1].c) > 1 and abs(a[0].s - a[2].s) < 0.05 and all(-1 <= x.s <= 1 for x in a)
    r = spark.createDataFrame([(9.0, 10.0)], "o double, t double").select((F.col("o") - X.oxygen_saturation("t")).alias("d")).first()
    assert r.d == pytest.approx(-2.288, abs=1e-3)


def test_cross_sensor_columns_only_when_inputs_exist(spark):
    d = spark.createDataFrame([(100.0, 50.0), (100.0, 0.0)], "turbidity_instant double, discharge_instant double")
    assert [r.turb_flow_ratio for r in X.cross_sensor(d).collect()] == [2.0, None]
    assert X.cross_sensor(spark.createDataFrame([(1,)], "other int")).columns == ["other"]


def test_perfect_and_biased_scores(spark):
    d = spark.createDataFrame([(1, float(i), float(i)) for i in range(1, 6)], "site long, y double, p double")
    r = MT.site_skill(d, ["site"], "y", "p", ["r2", "rmse", "kge"]).first()
    assert (r.r2, r.rmse) == (1.0, 0.0) and r.kge == pytest.approx(1.0)
    b = spark.createDataFrame([(1, 100.0, 110.0), (1, 200.0, 210.0), (1, 300.0, 310.0)], "site long, y double, p double")
    assert MT.site_skill(b, ["site"], "y", "p", ["pbias"]).first().pbias == pytest.approx(5.0)


def test_constant_columns_give_null_not_errors(spark):
    d = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, 6.0)], "site long, y double, p double")
    r = MT.full_report(d, ["site"], "y", "p").first()
    assert r.nse is None and r.kge is None and r.spearman_rho is None and r.n == 2


def test_sensor_family_and_region(spark):
    d = spark.createDataFrame([(" ts213", "unknown"), (None, "3")], "m string, h string")
    assert [(r.a, r.b) for r in d.select(N.sensor_family("m").alias("a"), N.region_code("h").alias("b")).collect()] == [("exo", None), ("unknown", "03")]
