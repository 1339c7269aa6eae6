"""Events: the flow is windowed once."""

from __future__ import annotations

import datetime as dt

from freshet.operators import events as E


def day(n: int) -> dt.datetime:
    return dt.datetime(2000, 1, 1) + dt.timedelta(days=n)


def test_steps_after_the_flips_do_not_window_the_flow_again(spark):
    rows = [(1, day(i), 10.0 if 8 <= i < 12 else 1.0) for i in range(20)]
    d = E.detect(spark.createDataFrame(rows, "site long, day timestamp_ntz, q double"), "site", "day", "q", rows=7, min_count=3, rise=3.0, min_h=48, sep_h=72, slice_s=864_000)
    assert "_hb" not in d._jdf.queryExecution().executedPlan().toString()
    assert [(r.start, r.end, r.peak) for r in d.collect()] == [(day(8), day(12), 10.0)]
