"""A site's own rating curve against the locally corrected model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from freshet.operators import metrics as M, trials as T

CURVE = {"a": "u_a", "b": "u_b", "f": "u_f"}
NAMES = ["r2", "slope", "rmse"]
OUT = [f"{tag}_{x}" for tag in ("usgs", "ours") for x in NAMES]


def _fits(sets: DataFrame) -> DataFrame:
    """Both fits of each set."""
    fits = T.fit_log10(sets.withColumn("_all", F.col("cal"))).withColumn("cal", F.col("_all")).drop("_all").withColumnsRenamed(CURVE)
    return T.fit_linear(fits, recentre=False, floor=1e-6)


def _predicted(f, x: dict, text) -> np.ndarray:
    """Predictions of the curve and of the model as two matrices."""
    u = x["x"]
    curve = np.where(u > 0, np.power(10.0, f("u_b") + f("u_a") * np.log10(np.where(u > 0, u, 1.0))) * f("u_f"), np.nan)
    return np.stack([curve, T.line_matrix()(f, x, text)])


def _measured(y: np.ndarray, pred: np.ndarray, test: np.ndarray) -> dict[str, np.ndarray]:
    """``metrics.report_from`` of both methods for each row of the matrices; NaN where a metric is not defined."""
    out = {"n_test": test.sum(1)}
    for tag, p in zip(("usgs", "ours"), pred):
        ok = test & ~np.isnan(y)[None, :] & ~np.isnan(p)
        n = ok.sum(1)
        mean = lambda x: np.where(ok, x, 0.0).sum(1) / n  # noqa: E731, B023
        dy, dp = y[None, :] - mean(y[None, :])[:, None], p - mean(p)[:, None]
        vy, sse = mean(dy * dy), np.where(ok, (y[None, :] - p) ** 2, 0.0).sum(1)
        out[f"{tag}_r2"] = np.where(n > 0, 1 - sse / np.maximum(vy * n, M.TINY), np.nan)
        out[f"{tag}_slope"] = np.where(vy > 0, mean(dy * dp) / vy, np.nan)
        out[f"{tag}_rmse"] = np.sqrt(np.where(n > 0, sse / n, np.nan))
    return out


def curve_versus_model(df: DataFrame, site: str, uid: str, t: str, cols: list[str], sizes: list[int], trials: int, modes: list[str], seed: int) -> DataFrame:
    """Both methods on the same calibration rows; medians over a site's sets and their difference.

    Sites up to ``trials.SITE`` rows are drawn, fitted and scored where their rows lie. For a larger one both fits travel in one
    list per site, so rows are expanded and tested once.
    """
    parts = T.calibration_parts(df, site, uid, t, cols, sizes, trials, modes, seed)
    m = T.packed_scores(_fits(parts[0][1]), site, {c: c for c in ("y", "p", "x")}, _predicted, _measured, OUT, [], [], 1, apart=True).select(site, *OUT)
    for rows, sets in parts[1:]:
        m = m.unionByName(_large(rows, sets, site, uid, t))
    return m.withColumn("r2_advantage", F.col("ours_r2") - F.col("usgs_r2")).withColumn("rmse_advantage", F.col("usgs_rmse") - F.col("ours_rmse"))


def _large(rows: DataFrame, sets: DataFrame, site: str, uid: str, t: str) -> DataFrame:
    d = T.scored(rows, _fits(sets), site, uid, t, {c: c for c in ("y", "p", "x")}, T.apply_line())
    u = F.when(F.col("x") > 0, F.pow(F.lit(10.0), F.col("u_b") + F.col("u_a") * F.log10("x")) * F.col("u_f"))
    d = d.withColumnRenamed("n", "n_cal").withColumn("_curve", u)
    g = d.groupBy(site, "mode", "n_cal", "trial").agg(*M.base_sums("y", "_pred", "_o_"), *M.base_sums("y", "_curve", "_u_"))
    out = {}
    for tag, prefix in (("usgs", "_u_"), ("ours", "_o_")):
        rep = M.report_from(prefix)
        out |= {f"{tag}_{x}": rep[x] for x in NAMES}
    g = g.select(site, *[e.alias(k) for k, e in out.items()])
    return g.groupBy(site).agg(*[F.median(k).alias(k) for k in OUT])  # trials per site: a parameter
