"""Operators without a SQL check, against brute force or invariants."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import metrics as M, regression as G
from freshet.plans import models as P
from freshet.sources import files as S
from freshet.streaming import incremental as I


def test_ridge_leave_site_out_matches_refits(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"site": rng.integers(0, 6, n), "a": rng.normal(5, 2, n), "b": rng.normal(0, 1, n), "c": rng.choice(["u", "v"], n)})
    pdf["y"] = np.square(2 + 0.5 * pdf.a - 0.3 * pdf.b + (pdf.c == "u") * 0.7 + rng.normal(0, 0.2, n))
    got = G.ridge_logo(spark.createDataFrame(pdf), "site", ["a", "b"], {"c": ["u", "v"]}, "y", alpha=1.0).toPandas().set_index("site")
    x = np.column_stack([pdf.a, pdf.b, pdf.c == "u", pdf.c == "v"]).astype(float)
    t = np.sqrt(pdf.y.values)
    for s in range(6):
        tr, te = (pdf.site != s).values, (pdf.site == s).values
        mx, mt = x[tr].mean(0), t[tr].mean()
        w = np.linalg.solve((x[tr] - mx).T @ (x[tr] - mx) + np.eye(4), (x[tr] - mx).T @ (t[tr] - mt))
        fit = lambda z: mt + (z - mx) @ w
        p, y = fit(x[te]), t[te]
        factor = (t[tr] ** 2).mean() / (fit(x[tr]) ** 2).mean()
        assert got.r2[s] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
        assert got.factor[s] == pytest.approx(factor, rel=1e-9)
        nat = p**2 * factor
        assert got.rmse_native[s] == pytest.approx(np.sqrt(((y**2 - nat) ** 2).mean()), rel=1e-9)


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(7)
    n = 1200
    pdf = pd.DataFrame({"site": rng.integers(0, 25, n), "turb": rng.lognormal(3, 1, n), "flow": rng.random(n) * 100, "method": rng.choice(["a", "b"], n)})
    pdf["y"] = pdf.turb * 2 * np.exp(rng.normal(0, 0.2, n))
    pdf["target"] = np.log1p(pdf.y)
    return spark.createDataFrame(pdf)


def test_boosting_beats_the_mean(training):
    pipe = P.boosted(["turb", "flow"], ["method"], "target", maxIter=5, maxDepth=3)
    model, factor = P.train_final(training, pipe, "site", "y", "log1p", None)
    assert 0.5 <= factor.first().factor <= 3.0
    s = P.score(training, model, factor, "y", "log1p", None, ["site"])
    r = M.site_skill(s, [], "y", "pred_native", ["n", "r2"]).first()
    assert r.n == 1200 and r.r2 > 0.5
    assert s.where(F.col("pred_native").isNull() | F.isnan("pred_native")).count() == 0


def test_cv_scores_every_row_once(training):
    oof, folds = P.grouped_cv(training, P.linear(["flow", "turb"], "target"), "site", "target", "y", "log1p", None, folds=3)
    assert oof.count() == 1200 and folds.count() == 3
    assert oof.groupBy("site").agg(F.countDistinct("fold").alias("k")).where("k <> 1").count() == 0


def test_missing_and_empty_features_are_errors(training):
    with pytest.raises(ValueError, match="missing features"):
        P.select_features(training, ["nope"], [], [])
    with pytest.raises(ValueError, match="without any value"):
        P.select_features(training.withColumn("e", F.lit(None).cast("double")), ["turb", "e"], [], [])


def test_ingest_resumes_and_does_not_repeat(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    d = spark.range(100).select((F.col("id") % 7).alias("site"), F.col("id").alias("t"), F.col("id").alias("uid"))
    args = (spark, src, out, ck, d.schema, ["site", "t"], ["uid"])
    d.where("t < 60").write.mode("append").parquet(src)
    I.ingest(*args)
    assert I.ingested(spark, out, ["site", "t"], ["uid"]).count() == 60
    d.where("t >= 40").withColumn("uid", F.col("uid") + 1000).write.mode("append").parquet(src)
    I.ingest(*args)
    I.ingest(*args)
    r = I.ingested(spark, out, ["site", "t"], ["uid"])
    assert r.count() == 100 and r.where("t between 40 and 59 and uid >= 1000").count() == 0


def test_sensor_columns():
    cols = ["site", "63680", "63680_cd", "63680_bgc", "00060_ysi", "00060_ysi_cd", "x"]
    assert S.sensor_columns(cols, ["63680", "00060"]) == {"63680": ["63680", "63680_bgc"], "00060": ["00060_ysi"]}
    assert (S.primary_column(cols, "63680"), S.primary_column(cols, "00060"), S.primary_column(cols, "00095")) == ("63680", "00060_ysi", None)
