"""Grids and trailing minima: what is shuffled and sorted, and that slices and missing sites change nothing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from freshet.operators import grid as G, windows as WN


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def readings(spark, rows):
    return spark.createDataFrame(rows, "site long, code string, t timestamp_ntz, value double")


def day(n: int) -> dt.datetime:
    return dt.datetime(2000, 1, 1) + dt.timedelta(days=n)


def test_steps_of_a_grid_are_not_shuffled(spark):
    d = G.build(readings(spark, [(1, "q", day(0), 1.0)]), "site", "code", "t", 86_400, {"q": "q"}, 2)
    above = plan(d).split("Generate")[0]
    assert "Exchange" not in above and "Join" not in above


def test_columns_fill_apart_and_across_slices(spark):
    rows = [(1, "q", day(0), 1.0), (1, "c", day(1), 5.0), (1, "q", day(4), 9.0), (1, "c", day(5000), None), (1, "q", day(9000), 2.0)]
    got = {r.idx - 10957: (r.q, r.c) for r in G.build(readings(spark, rows), "site", "code", "t", 86_400, {"q": "q", "c": "c"}, 2).collect()}
    assert len(got) == 9001
    assert [got[i] for i in (0, 1, 2, 3, 4)] == [(1.0, None), (3.0, 5.0), (5.0, 5.0), (None, 5.0), (9.0, None)]
    step = (2.0 - 9.0) / 8996
    assert abs(got[5][0] - (9.0 + step)) < 1e-12 and got[7] == (None, None) and got[5000] == (None, None) and got[9000] == (2.0, None)


def test_a_missing_site_has_a_whole_grid_without_values(spark):
    rows = [(None, "q", day(0), 1.0), (None, "q", day(9000), 2.0)]
    got = G.build(readings(spark, rows), "site", "code", "t", 86_400, {"q": "q"}, 2).collect()
    assert len(got) == 9001 and all(r.q is None and r.site is None for r in got)


def test_trailing_minima_sort_once(spark):
    d = spark.range(10).select(F.lit(1).alias("site"), F.col("id").alias("idx"), F.col("id").cast("double").alias("q"))
    assert plan(WN.trailing_rows_min(d, ["site"], "idx", "q", 672, 1, "lo")).count("Sort [") == 1


def test_trailing_means_of_two_lengths_share_one_sort(spark):
    d = spark.range(10).select(F.lit(1).alias("site"), F.col("id").alias("idx"), F.col("id").cast("double").alias("q"))
    m = WN.trailing_rows_mean(d, ["site"], "idx", "q", {"a": 2, "b": 4}, 2)
    assert plan(m).count("Sort [") == 1
    assert [(r.a, r.b) for r in m.orderBy("idx").collect()][:4] == [(None, None), (0.5, 0.5), (1.5, 1.0), (2.5, 1.5)]
