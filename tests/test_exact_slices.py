"""Slices by depth, time layouts, ties of visits, given grids, Box-Cox, ridge with gaps."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import normalize as N
from freshet.operators import attributes as A, blocks as B, grid as G, matching as M, regression as R


@pytest.mark.parametrize("kind", ["narrow", "lumped"])
def test_crowded_slices_are_cut_by_depth(spark, monkeypatch, kind):
    monkeypatch.setattr(B, "TARGET", 100)
    rng = np.random.default_rng(2)
    v = rng.random(6_000) / 1000 if kind == "narrow" else np.where(rng.random(6_000) < 0.5, 1e6 + rng.random(6_000) * 1e-6, 1e6 + rng.random(6_000))
    v[::7] = v[0]
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 2, 6_000), "v": v})).withColumn("i", F.monotonically_increasing_id())
    counted = B._counted(df, ["g"], [F.col("v")])
    rows = counted.join(B._offsets(counted, ["g"]).drop("_bn", "_tot"), ["g", "_c", "_blk"])
    assert rows.agg(F.max("_bm")).first()[0] > 1000
    parts = B.cut_crowded(rows.where("_bm > 100"), ["g", "_c", "_blk"]).groupBy("g", "_blk", "_sub").count()
    assert parts.agg(F.max("count")).first()[0] <= 100
    pdf = df.toPandas()
    got = B.quantiles(df, ["g"], {"a": ("v", 0.1), "m": ("v", 0.5), "z": ("v", 0.999)}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g].tolist() == pytest.approx(np.quantile(part.v, [0.1, 0.5, 0.999]).tolist(), rel=1e-14)
    ranked = B.average_rank(df, ["g"], {"r": "v"}).toPandas().sort_values("i")
    assert np.allclose(ranked.r, pdf.sort_values("i").groupby("g").v.rank())


def test_time_layouts(spark):
    at = dt.datetime(2020, 1, 2, 9, 5, 7)
    five = lambda s: at.replace(second=0) + dt.timedelta(hours=s)
    rows = [
        ("2020-01-02", "09:05:07", "UTC", at), ("2020-01-02", "9:05:07", "EST", at + dt.timedelta(hours=5)), ("2020-1-2", "9:5:7", "UTC", at),
        ("2020-01-02T09:05:07", None, "UTC", at), ("2020-01-02T09:05:07Z", "", "EST", at), ("2020-01-02", "09:05:07.250", "UTC", at.replace(microsecond=250_000)),
        ("2020-01-02", "09:05:07-05:00", "PST", at + dt.timedelta(hours=5)), ("2020-01-02", "09:05", "UTC", five(0)), ("2020/01/02", "9:05", "CST", five(6)), ("1/2/2020", "9:05:07", "UTC", at),
        ("20200102", "0905", "UTC", five(0)), ("20200102", "090507", "UTC", at), ("2020-01-02", None, "UTC", None), ("2020-01-02", " ", "UTC", None), ("2020-02-30", "09:05:07", "UTC", None),
        ("2020-01-02", "25:05:07", "UTC", None), ("yesterday", "noon", "UTC", None), ("2020-01-02", "09:05:07", "XXX", None), (None, "09:05:07", "UTC", None), ("", "", "", None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, d string, c string, z string")
    got = {r.i: r.t for r in df.select("i", N.to_utc("d", "c", "z").alias("t")).collect()}
    wrong = [(r, got[i]) for i, r in enumerate(rows) if got[i] != r[3]]
    assert not wrong, wrong


def test_visits_at_one_time_have_one_winner(spark):
    t = dt.datetime(2020, 1, 1)
    visits = [("a", t, float(i), f"f{i % 3}") for i in range(60)]
    samples = spark.createDataFrame([("a", t + dt.timedelta(hours=i), i) for i in range(-1, 5)], "site string, st timestamp_ntz, pos long")
    seen = set()
    for k, rows in enumerate((visits, visits[::-1])):
        v = spark.createDataFrame(rows, "site string, vt timestamp_ntz, off double, fam string").repartition(3 + 2 * k)
        seen.add(tuple(sorted((r.pos, r.off, r.fam) for r in M.last_known(samples, v, ["site"], "st", "vt", ["off", "fam"], "pos", 3600).where("off is not null").collect())))
    assert seen == {tuple((i, 59.0, "f2") for i in range(5))}


def test_given_grid_keeps_the_first_reading_and_both_ends(spark):
    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
    rows = [("a", "q", day(2), 5.0, 1), ("a", "q", day(2), 1.0, 2), ("a", "q", day(4), None, 1), ("a", "q", day(4), 9.0, 2), ("a", "q", day(5), 8.0, 1), ("a", "q", day(40), 7.0, 1), ("b", "q", day(90_000), 1.0, 1)]
    df = spark.createDataFrame(rows, "site string, code string, t timestamp_ntz, value double, pos int")
    got = G.build(df, "site", "code", "t", 86_400, {"q": "q"}, 2, "q", "2020-01-01", "2020-01-10", "pos").orderBy("site", "time").collect()
    assert [r.q for r in got if r.site == "a"] == [None, None, 5.0, 6.0, 7.0, 8.0, 8.0, 8.0, None, None]
    assert [r.q for r in got if r.site == "b"] == [None] * 10 and got[0].time == day(0) and got[9].time == day(9)
    far = df.where("site = 'b'").unionByName(df.where("site = 'b'").withColumn("t", F.lit(day(0))))
    assert G.build(far, "site", "code", "t", 86_400, {"q": "q"}, None).count() == 90_001


def test_boxcox_optimum(spark):
    rng = np.random.default_rng(4)
    for y in (rng.lognormal(2, 0.7, 4_000), rng.random(3_000) * 50, np.cbrt(100 + rng.normal(0, 20, 2_000)) - 1):
        l, m = np.log1p(y), np.log1p(y).mean()  # noqa: E741
        llf = lambda k: (k - 1) * l.sum() - len(l) / 2 * (np.log(np.var(np.expm1(k * (l - m)) / k if abs(k) > 1e-9 else l)) + 2 * k * m)  # noqa: B023, E731
        lo, hi = -40.0, 40.0
        for _ in range(300):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (a, hi) if llf(a) < llf(b) else (lo, b)
        got = R.boxcox_lambda(spark.createDataFrame(pd.DataFrame({"y": y})), "y").first().lam
        assert llf(got) >= llf((lo + hi) / 2) - 1e-6 and got == pytest.approx((lo + hi) / 2, abs=2e-5)
    assert R.boxcox_lambda(spark.createDataFrame([(2.0,), (2.0,)], "y double"), "y").first().lam is None


@pytest.mark.parametrize("kind", ["sqrt", "log1p", "boxcox"])
def test_ridge_with_gaps_weights_and_categories(spark, kind):
    rng = np.random.default_rng(6)
    n, lam = 400, 0.3
    pdf = pd.DataFrame({"site": rng.integers(0, 7, n), "a": rng.normal(5, 2, n), "c": rng.choice(["u", "v", None], n), "w": rng.integers(1, 4, n)})
    pdf["y"] = np.square(2 + 0.4 * pdf.a + (pdf.c == "u") * 0.7 + rng.normal(0, 0.2, n))
    pdf.loc[::9, "a"] = np.nan
    pdf.loc[::23, "y"] = np.nan
    cats = {"c": ["u", "v", "missing"]}
    got = R.ridge_logo(spark.createDataFrame(pdf), "site", ["a"], cats, "y", kind=kind, lam=lam if kind == "boxcox" else None, weight="w").toPandas().set_index("site")
    d = pdf[pdf.y.notna()]
    c = d.c.fillna("missing")
    x = np.column_stack([d.a.fillna(d.a.median()), *[c == v for v in cats["c"]]]).astype(float)
    y, w = d.y.to_numpy(), d.w.to_numpy(float)
    fore, back = {
        "sqrt": (np.sqrt, np.square), "log1p": (np.log1p, np.expm1),
        "boxcox": (lambda v: ((1 + v) ** lam - 1) / lam, lambda v: np.clip((np.maximum(v, -1 / lam + 1e-10) * lam + 1) ** (1 / lam) - 1, 0, 1e8)),
    }[kind]
    t = fore(y)
    for s in range(7):
        tr, te = (d.site != s).to_numpy(), (d.site == s).to_numpy()
        mx, mt = np.average(x[tr], axis=0, weights=w[tr]), np.average(t[tr], weights=w[tr])
        z = x[tr] - mx
        coef = np.linalg.solve(z.T @ (z * w[tr][:, None]) + np.eye(x.shape[1]), z.T @ ((t[tr] - mt) * w[tr]))
        fit = lambda v: mt + (v - mx) @ coef  # noqa: B023, E731
        factor = np.exp(t[tr] - fit(x[tr])).mean() if kind == "log1p" else y[tr].mean() / back(fit(x[tr])).mean()
        p = fit(x[te])
        assert got.factor[s] == pytest.approx(factor, rel=1e-9)
        assert got.r2[s] == pytest.approx(1 - ((t[te] - p) ** 2).sum() / ((t[te] - t[te].mean()) ** 2).sum(), abs=1e-9)
        nat = np.maximum(back(p) * factor, 0)
        assert got.rmse_native[s] == pytest.approx(np.sqrt(((y[te] - nat) ** 2).mean()), rel=1e-9)


def test_few_raw_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="raw columns"):
        A.prune_attributes(spark.createDataFrame([(1, 2.0, 3.0)], "site int, FORESTNLCD06 double, other double"), "site")
