"""One entity holds most rows: results must not change and plans must not degenerate."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.catalog import QUERIES
from freshet.operators import events as E, windows as WN
from freshet.operators.blocks import average_rank, keep_first, ordered, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 6000
    site = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 20, n))
    pdf = pd.DataFrame({"site": site, "uid": np.arange(n), "t": rng.integers(0, 4_000, n) * 3600, "v": np.round(rng.lognormal(1, 2, n), 2) * rng.choice([-1, 1], n)})
    pdf.loc[rng.random(n) < 0.05, "v"] = None
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "site long, uid long, t long, v double")
    return pdf, d.withColumn("time", F.timestamp_seconds("t").cast("timestamp_ntz"))


def test_quantiles_match_numpy(skewed):
    pdf, d = skewed
    ps = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r.site: r for r in quantiles(d, ["site"], {f"q{i}": ("v", p) for i, p in enumerate(ps)}).collect()}
    for s, g in pdf.dropna().groupby("site"):
        assert [got[s][f"q{i}"] for i in range(len(ps))] == pytest.approx(list(np.quantile(g.v, ps)))


def test_quantiles_survive_one_value_only(spark):
    d = spark.createDataFrame([(1, 3.0)] * 1000, "site long, v double")
    assert quantiles(d, ["site"], {"a": ("v", 0.3), "b": ("v", 1.0)}).first()[1:] == (3.0, 3.0)


def test_average_rank_matches_pandas(skewed):
    pdf, d = skewed
    got = average_rank(d.select("site", "uid", "v"), ["site"], {"r": "v"}).toPandas().set_index("uid").r.sort_index()
    want = pdf.set_index("uid").groupby("site").v.rank()
    assert np.allclose(got.astype(float), want, equal_nan=True)


@pytest.mark.parametrize("width", [3600, 50 * 3600, 10_000 * 3600])
def test_ordered_does_not_depend_on_the_slices(skewed, width):
    pdf, d = skewed
    o = ordered(d, ["site"], ["t", "uid"], F.floor(F.col("t") / width), number="n", total="m", prev={"p": F.col("v")}, last={"l": F.col("v")}, follow={"f": F.col("v")}, running={"s": F.col("v")})
    got = o.toPandas().set_index("uid").sort_index()
    w = pdf.sort_values(["site", "t", "uid"])
    g = w.groupby("site")
    want = pd.DataFrame({"uid": w.uid, "n": g.cumcount() + 1, "m": g.uid.transform("size"), "l": g.v.ffill()})
    want["p"] = want.groupby(w.site).l.shift(1)
    want["b"] = g.v.bfill()
    want["f"] = want.groupby(w.site).b.shift(-1)
    want["s"] = w.v.fillna(0).groupby(w.site).cumsum()
    want = want.set_index("uid").sort_index()
    for x in ("n", "m", "l", "p", "f"):
        assert np.allclose(got[x].astype(float), want[x].astype(float), equal_nan=True), x
    has = got.s.notna()
    assert np.allclose(got.s[has].astype(float), want.s[has])


def test_sessions_do_not_depend_on_the_slices(skewed):
    pdf, d = skewed
    a = [WN.sessionize(d, ["site"], "time", "uid", 7200, w).toPandas().set_index("uid").session.sort_index() for w in (3600, 86_400, 1e8)]
    w = pdf.sort_values(["site", "t", "uid"])
    want = pd.Series((w.groupby("site").t.diff() > 7200).groupby(w.site).cumsum().astype(int).values, index=w.uid).sort_index()
    assert all((x == want).all() for x in a)


@pytest.mark.parametrize("k", [3, 7, 40])
def test_trailing_windows_match_pandas(spark, monkeypatch, k):
    monkeypatch.setattr(WN, "MIN_SLICE_ROWS", 64)  # many slices on a small series
    rng = np.random.default_rng(1)
    pdf = pd.concat([pd.DataFrame({"site": s, "idx": np.arange(5 * s, 5 * s + n), "q": rng.random(n)}) for s, n in ((0, 900), (1, 50), (2, 2))])
    pdf.loc[rng.random(len(pdf)) < 0.2, "q"] = np.nan
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "site long, idx long, q double")
    d = WN.trailing_rows_min(WN.trailing_rows_mean(d, ["site"], "idx", "q", k, 2, "m"), ["site"], "idx", "q", k, 2, "lo")
    got = d.toPandas().sort_values(["site", "idx"])
    g = pdf.sort_values(["site", "idx"]).groupby("site").q
    assert np.allclose(got.m.astype(float), g.transform(lambda x: x.rolling(k, min_periods=2).mean()), equal_nan=True)
    assert np.allclose(got.lo.astype(float), g.transform(lambda x: x.rolling(k, min_periods=2).min()), equal_nan=True)


def test_keep_first_ignores_row_order(spark):
    rows = [(1, i, float(i)) for i in range(500)]
    a = spark.createDataFrame(rows[::-1], "k long, pos long, v double").repartition(7)
    assert [tuple(r) for r in keep_first(a, ["k"], ["pos"]).collect()] == [(1, 0, 0.0)]


def reference_events(q, rows, mc, rise, min_h, sep_h):
    q = q.dropna()
    if len(q) < rows:
        return []
    up = (q > q.rolling(rows, min_periods=mc).min() * rise).tolist()
    ev, start = [], None
    for t, u in zip(q.index, up):
        if u and start is None:
            start = t
        elif not u and start is not None:
            ev.append([start, t])
            start = None
    if start is not None:
        ev.append([start, q.index[-1]])
    ev = [e for e in ev if (e[1] - e[0]).total_seconds() / 3600 >= min_h]
    out = []
    for e in ev:
        if out and (e[0] - out[-1][1]).total_seconds() / 3600 < sep_h:
            out[-1][1] = e[1]
        else:
            out.append(e)
    return [tuple(e) for e in out]


def test_events_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(WN, "MIN_SLICE_ROWS", 32)
    rng = np.random.default_rng(3)
    idx = pd.date_range("2020-01-01", periods=1500, freq="h")
    base = np.exp(np.cumsum(rng.normal(0, 0.25, 1500)) * 0.5)
    q = pd.Series(base, index=idx)
    q[rng.random(1500) < 0.1] = np.nan
    rows = [(1, t.to_pydatetime(), None if np.isnan(v) else float(v)) for t, v in q.items()]
    d = spark.createDataFrame(rows, "site long, t timestamp_ntz, q double")
    got = E.detect(d, "site", "t", "q", rows=24, min_count=6, rise=1.5, min_h=3, sep_h=8, slice_s=3 * 86_400).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(a.to_pydatetime(), b.to_pydatetime()) for a, b in reference_events(q, 24, 6, 1.5, 3, 8)]
    assert got[0].peak == pytest.approx(q[got[0].start:got[0].end].max())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["join_interp", "join_window_stats", "join_align", "join_asof_last", "join_nearest_geo", "win_antecedent", "qc_buffer", "dedup_conflict", "agg_site_metrics", "evt_detect", "adapt_bayes", "pi_mondrian_apply"])
def test_no_cross_or_nested_loop_join(spark, sf_dir, name):
    p = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_scans_read_only_needed_columns(spark, sf_dir):
    p = plan(QUERIES["agg_r2"](spark, sf_dir))
    schema = p[p.index("ReadSchema"):].split("\n")[0]
    assert "o_custkey" in schema and "o_orderpriority" not in schema and "o_orderdate" not in schema


def test_result_does_not_depend_on_partitioning(spark, sf_dir):
    from freshet.plans.testbed import Testbed

    t = Testbed(spark, sf_dir)
    a = quantiles(t.pred.repartition(1), ["site"], {"m": ("y", 0.5)}).toPandas().sort_values("site")
    b = quantiles(t.pred.repartition(23), ["site"], {"m": ("y", 0.5)}).toPandas().sort_values("site")
    assert np.array_equal(a.m.values, b.m.values)


def test_salted_join_lets_a_large_site_be_combined_first(spark, skewed):
    from freshet.functions.basics import spread_join

    pdf, d = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per = d.groupBy("site").agg(F.max("v").alias("top"))
        out = spread_join(d.drop("time"), per, ["site"]).groupBy("site").agg(F.sum(F.col("top") - F.col("v")).alias("s"), F.count("*").alias("n"))
        plan = out._jdf.queryExecution().sparkPlan().toString()
        got = {r.site: (r.s, r.n) for r in out.collect()}
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    head = text[: text.index("Join")]
    assert "Exchange hashpartitioning(site" in head and "SortMergeJoin" in plan
    for s, g in pdf.groupby("site"):
        assert got[s][1] == len(g) and got[s][0] == pytest.approx((g.v.max() - g.v).sum())


def test_rounding_keeps_large_values_and_nan(spark):
    from freshet.functions.basics import r

    df = spark.createDataFrame([(3e16,), (float("nan"),), (1.23456,), (-2.5,), (None,)], "x double").select(r("x", 4).alias("x"))
    got = [row.x for row in df.collect()]
    assert got[0] == 3e16 and np.isnan(got[1]) and got[2:] == [1.2346, -2.5, None]


def test_no_cap_on_qualifier_parts_and_open_top_bins(spark):
    from freshet.functions import normalize as N, transforms as X

    text = "A," + ",".join(f"q{i}" for i in range(1500))
    assert spark.createDataFrame([(text,)], "q string").select(N.batch_qualifier("q").alias("q")).first().q.endswith("q1499")
    assert spark.range(1).select(X.bin_right(F.lit(100_000), [0, 200, float("inf")], ["few", "many"]).alias("b")).first().b == "many"


@pytest.mark.parametrize("clock", ["10:00", "10:00:00", "10:00:00.250", "9:05"])
def test_time_forms(spark, clock):
    from freshet.functions import normalize as N

    df = spark.createDataFrame([("2024-05-01", clock, "EST")], "d string, c string, z string")
    assert df.select(N.to_utc("d", "c", "z").alias("t")).first().t is not None


def test_draws_are_never_the_broadcast_side(spark):
    """Behind an explode Spark takes the draws for the smaller table; replicates times entities then went through the driver."""
    from freshet.operators import bootstrap as B, sampling as S

    v = spark.range(300).selectExpr("id as site", "id % 7 as label", "cast(id * 37 % 101 as double) as v")
    drawn = S.bootstrap_rows(v, "site", 42, 50)
    p = plan(drawn)
    assert "ShuffledHashJoin" in p and "Generate" not in p[p.find("BroadcastExchange") if "BroadcastExchange" in p else len(p) :]
    assert drawn.groupBy("rep").count().select("count").distinct().collect()[0][0] == 300
    counted = S.bootstrap_rows(v, "site", 42, 50, counted=True)
    assert counted.agg(F.sum("m")).first()[0] == 300 * 50 and counted.groupBy("rep", "site").count().where("count > 1").isEmpty()
    one = B.median_by_group(v, "site", ["label"], "v", 42, 50).collect()
    picked = drawn.select("rep", "site", "label", "v").distinct().toPandas().groupby(["label", "rep"]).v.median().groupby("label").quantile([0.025, 0.975])
    assert len(one) == 7 and all((r.lo, r.hi) == (pytest.approx(picked[r.label, 0.025]), pytest.approx(picked[r.label, 0.975])) for r in one)


def test_nearest_point_against_a_loop_and_few_pairs(spark, monkeypatch):
    from freshet.operators import joins as J

    monkeypatch.setattr(J, "CELL_POINTS", 4)
    rng = np.random.default_rng(8)
    # a dense crowd, a thin rest, ties and points out of reach
    b = np.concatenate([np.round(rng.normal(10, 0.02, (400, 2)), 4), rng.uniform(-5, 30, (60, 2)), [[3.0, 3.0], [3.0, 4.0]]])
    a = np.concatenate([np.round(rng.normal(10, 0.05, (60, 2)), 4), rng.uniform(-20, 45, (60, 2)), [[3.0, 3.5]]])
    frame = lambda x, k: spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], f"{k} long, lat double, lon double")
    got = {r.u: (r.w, r.distance) for r in J.nearest_geo(frame(a, "u"), frame(b, "w"), "u", "w", 2.0).collect()}
    want = {}
    for i, p in enumerate(a):
        d = np.sqrt(((b - p) * (b - p)).sum(1))
        if d.min() < 2.0:
            want[i] = (int(np.argmin(d)), d.min())
    assert set(got) == set(want) and 60 < len(want) < len(a)
    assert all(got[i][0] == w and got[i][1] == pytest.approx(d) for i, (w, d) in want.items())
