"""Numeric transforms and engineered features as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.basics import c, clip, ratio, with_scalar
from freshet.operators.blocks import quantiles

NATIVE_MAX = 1e8


def forward(x: str | Column, kind: str, lam: float | None = None) -> Column:
    v = clip(x, lo=0)
    if kind == "log1p" or (kind == "boxcox" and lam == 0):
        return F.log1p(v)
    if kind == "boxcox":
        return (F.pow(v + 1, F.lit(float(lam))) - 1) / F.lit(float(lam))
    if kind == "sqrt":
        return F.sqrt(v)
    if kind == "none":
        return c(x)
    raise ValueError(f"unknown transform {kind!r}")


def inverse(y: str | Column, kind: str, lam: float | None = None) -> Column:
    """Back to native units; Box-Cox is clamped to its domain and to [0, 1e8]."""
    y = c(y)
    if kind == "log1p" or (kind == "boxcox" and lam == 0):
        return F.expm1(y)
    if kind == "boxcox":
        safe = F.greatest(y, F.lit(-1.0 / lam + 1e-10)) if lam > 0 else y
        return clip(F.when(y.isNotNull(), F.pow(safe * F.lit(float(lam)) + 1, F.lit(1.0 / lam)) - 1), 0, NATIVE_MAX)
    if kind == "sqrt":
        return y * y
    if kind == "none":
        return y
    raise ValueError(f"unknown transform {kind!r}")


def inverse_array(kind: str, lam: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """``inverse`` for numpy arrays inside a task."""
    if kind == "log1p" or (kind == "boxcox" and lam == 0):
        return np.expm1
    if kind == "boxcox":
        low = -1.0 / lam + 1e-10 if lam > 0 else -np.inf
        return lambda y: np.clip((np.maximum(y, low) * lam + 1) ** (1.0 / lam) - 1, 0, NATIVE_MAX)
    if kind == "sqrt":
        return np.square
    if kind == "none":
        return lambda y: y
    raise ValueError(f"unknown transform {kind!r}")


def oxygen_saturation(temp_c: str | Column) -> Column:
    """Dissolved oxygen at saturation (mg/L, 1 atm) from clipped temperature."""
    # fixed values: published Benson-Krause coefficients
    k = clip(temp_c, 0, 40) + 273.15
    return F.exp(
        F.lit(-139.34411) + 1.575701e5 / k - 6.642308e7 / (k * k) + 1.2438e10 / (k * k * k) - 8.621949e11 / (k * k * k * k)
    )


def cross_sensor(df: DataFrame, turb="turbidity_instant", flow="discharge_instant", cond="conductance_instant") -> DataFrame:
    out = df
    if {turb, flow} <= set(df.columns):
        out = out.withColumn("turb_flow_ratio", ratio(turb, flow))
    if {turb, cond} <= set(df.columns):
        out = out.withColumn("cond_turb", F.col(cond) * F.col(turb))
    return out


def season(t: str | Column) -> tuple[Column, Column]:
    angle = F.dayofyear(c(t)) * F.lit(2 * math.pi) / F.lit(365.25)
    return F.sin(angle), F.cos(angle)


def flag(cond: Column) -> Column:
    """1.0 / 0.0, a missing input counts as 0.0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def flush(dry_days: str | Column, rain: str | Column) -> Column:
    return F.log1p(c(dry_days)) * F.log1p(c(rain))


def bin_right(x: str | Column, edges: list[float], labels: list[str]) -> Column:
    """(a, b] bins; values at or below the first edge or above the last are NULL."""
    x, out = c(x), F.lit(None).cast("string")
    for lo, hi, lab in zip(edges, edges[1:], labels):
        out = F.when((x > lo) & (x <= hi), lab).otherwise(out)
    return out


def bin_left(x: str | Column, edges: list[float], labels: list[str]) -> Column:
    """[a, b) bins, open above the last finite edge."""
    x, out = c(x), F.lit(None).cast("string")
    for lo, hi, lab in zip(edges, [*edges[1:], math.inf], labels):
        cond = (x >= lo) if hi == math.inf else (x >= lo) & (x < hi)
        out = F.when(cond, lab).otherwise(out)
    return out


def quantile_bins(df: DataFrame, value: str, labels: list[str], out: str) -> DataFrame:
    """Equal-count bins over the whole table, right-closed, lowest value included."""
    n = len(labels)
    edges = quantiles(df, [], {f"_q{i}": (value, i / n) for i in range(1, n)})
    d = with_scalar(df, edges)
    col = F.lit(labels[-1])
    for i in range(n - 1, 0, -1):
        col = F.when(F.col(value) <= F.col(f"_q{i}"), labels[i - 1]).otherwise(col)
    return d.withColumn(out, F.when(F.col(value).isNotNull(), col)).drop(*[f"_q{i}" for i in range(1, n)])


def impute(df: DataFrame, train: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Numeric NULL to the training median, categorical NULL to `missing`."""
    med = quantiles(train, [], {f"_m_{n}": (n, 0.5) for n in numeric})
    d = with_scalar(df, med)
    return d.select(
        *[
            F.coalesce(F.col(x), F.col(f"_m_{x}")).alias(x) if x in numeric
            else F.coalesce(F.col(x), F.lit("missing")).alias(x) if x in categorical
            else F.col(x)
            for x in df.columns
        ]
    )


def sample_weights(df: DataFrame, value: str, scheme: str, out: str = "weight") -> DataFrame:
    """sqrt / log / linear weights scaled to mean one."""
    raw = {"sqrt": F.sqrt(value), "log": F.log1p(value), "linear": F.col(value)}[scheme]
    d = df.withColumn("_w", raw)
    return with_scalar(d, d.agg(F.avg("_w").alias("_mw"))).withColumn(out, F.col("_w") / F.col("_mw")).drop("_w", "_mw")


def dominant(cols: dict[str, str]) -> Column:
    """Name of the largest percentage (first wins ties), NULL when all are zero or missing."""
    entries = F.array(
        *[
            F.struct(F.coalesce(F.col(x), F.lit(0.0)).cast("double").alias("p"), F.lit(-i).alias("o"), F.lit(name).alias("n"))
            for i, (x, name) in enumerate(cols.items())
        ]
    )
    total = sum((F.coalesce(F.col(x), F.lit(0.0)) for x in cols), F.lit(0.0))
    return F.when(total != 0, F.array_max(entries)["n"])


