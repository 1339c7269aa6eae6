"""Linear fits from mergeable sums: per site, pooled, leave-one-site-out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions import transforms as X
from freshet.functions.basics import c, clip, settle, spread_join, with_scalar
from freshet.operators import metrics as M
from freshet.operators.blocks import quantiles

TINY = 1e-10


def line_fit(df: DataFrame, by: list[str], x: str | Column, y: str | Column, min_n: int = 2) -> DataFrame:
    """slope, intercept and n per group; no spread in x gives NULL."""
    x, y = c(x), c(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    g = df.groupBy(*by).agg(F.count(x).alias("n_fit"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"))
    g = g.where(F.col("n_fit") >= min_n).withColumn("slope", F.col("_c") / F.nullif(F.col("_v"), F.lit(0.0)))
    return g.select(*by, "n_fit", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))


def site_lines(df: DataFrame, site: str, x: Column, y: Column, train: str = "is_train", min_n: int = 10) -> DataFrame:
    """Fit on the training rows of each site, R2 on its test rows."""
    d = df.select(site, train, x.alias("_x"), y.alias("_y"))
    ok = d.groupBy(site).agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    fit = line_fit(d.where(F.col(train)), [site], "_x", "_y")
    test = d.where(~F.col(train)).transform(lambda x: spread_join(x, fit, [site])).withColumn("_p", F.col("intercept") + F.col("slope") * F.col("_x"))
    score = M.site_skill(test, [site], "_y", "_p", ["r2"])
    return ok.join(fit.select(site, "slope", "intercept"), site).join(score, site)


def pooled_line(df: DataFrame, site: str, x: Column, y: Column, train: str = "is_train", min_test: int = 3) -> DataFrame:
    """One fit on all training rows; test metrics per site and for ALL in one grouping."""
    d = df.select(F.col(site).cast("string").alias(site), train, x.alias("_x"), y.alias("_y"))
    fit = line_fit(d.where(F.col(train)), [], "_x", "_y")
    d = with_scalar(d, fit.select("slope", "intercept")).withColumn("_p", F.col("intercept") + F.col("slope") * F.col("_x"))
    smear = d.where(F.col(train)).agg(F.avg(F.exp(F.col("_y") - F.col("_p"))).alias("_sm"))
    test = with_scalar(d.where(~F.col(train)), smear)
    yn, pn = F.expm1("_y"), F.greatest(F.expm1("_p") * F.col("_sm"), F.lit(0.0))
    g = test.rollup(site).agg(
        *M.base_sums("_y", "_p"),
        F.sum((yn - pn) * (yn - pn)).alias("_nsse"), F.var_pop(yn).alias("_nvy"),
    ).where(F.col("_n") >= min_test)
    nat = 1 - F.col("_nsse") / F.greatest(F.col("_nvy") * F.col("_n"), F.lit(TINY))
    return g.select(F.coalesce(site, F.lit("ALL")).alias(site), F.col("_n").alias("n_test"), M.r2().alias("r2_log"), nat.alias("r2_native"))


def leave_site_out(df: DataFrame, site: str, x: Column, y: Column) -> DataFrame:
    """Each site scored by the line of all other sites: total sums minus its own.

    Sums are taken about the global means, so little precision is lost when one site
    holds most rows.
    """
    d = df.select(site, x.alias("_x0"), y.alias("_y0"))
    d = with_scalar(d, d.agg(F.avg("_x0").alias("_gx"), F.avg("_y0").alias("_gy")))
    d = d.select(site, (F.col("_x0") - F.col("_gx")).alias("x"), (F.col("_y0") - F.col("_gy")).alias("y"))
    names = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    own = d.groupBy(site).agg(*[F.sum(e).alias(k) for k, e in names.items()])
    g = with_scalar(own, own.agg(*[F.sum(k).alias(f"t_{k}") for k in names]))
    r = {k: F.col(f"t_{k}") - F.col(k) for k in names}
    cov, var = r["xy"] - r["x"] * r["y"] / r["n"], r["xx"] - r["x"] * r["x"] / r["n"]
    g = g.withColumn("b", cov / F.nullif(var, F.lit(0.0))).withColumn("a", (r["y"] - F.col("b") * r["x"]) / r["n"])
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    sse = F.col("yy") + n * a * a + b * b * F.col("xx") - 2 * a * F.col("y") - 2 * b * F.col("xy") + 2 * a * b * F.col("x")
    tot = F.col("yy") - F.col("y") * F.col("y") / n
    return g.select(site, n.cast("long").alias("n_test"), b.alias("slope"), (1 - sse / F.greatest(tot, F.lit(TINY))).alias("r2"))


def slope_correction(df: DataFrame, y: str, p: str, out: str = "corrected") -> DataFrame:
    """y ~ a p + b over the whole table, applied to every row."""
    fit = line_fit(df, [], p, y).select("slope", "intercept")
    return with_scalar(df, fit).withColumn(out, F.col("slope") * F.col(p) + F.col("intercept"))


def _likelihood(logs: DataFrame, middle: float, points: list[float]) -> dict[float, float]:
    """Box-Cox log-likelihood of (1 + x) at a few lambdas, from one aggregate over ln(1 + x).

    Logs are taken about their mean, which keeps large lambdas from losing all digits.
    """
    z = [F.col("_l") - middle if abs(k) < 1e-9 else F.expm1((F.col("_l") - middle) * k) / k for k in points]
    row = logs.agg(F.count("*").alias("n"), F.sum("_l").alias("s"), *[F.var_pop(e).alias(f"v{i}") for i, e in enumerate(z)]).first()
    return {k: (k - 1) * row["s"] - row["n"] / 2 * (math.log(row[f"v{i}"]) + 2 * k * middle) for i, k in enumerate(points) if row[f"v{i}"]}


def boxcox_lambda(df: DataFrame, value: str, lo: float = -1.0, hi: float = 1.0, points: int = 17, width: float = 4e-4) -> DataFrame:
    """Maximum-likelihood lambda of (1 + x), one row; NULL where the values have no spread.

    Each pass is one aggregate at a few points of a bracket, which then shrinks to the neighbours of the best point, or moves
    on if that is an end. The vertex of the parabola through the last three points follows, as by then rounding in the
    likelihood hides smaller steps.
    """
    logs = df.where(F.col(value) > -1).select(F.ln(F.col(value) + 1).alias("_l"))
    middle, best = logs.agg(F.avg("_l")).first()[0], None
    for _ in range(60 if middle is not None else 0):
        step = (hi - lo) / (points - 1)
        at = [lo + i * step for i in range(points)]
        ll = _likelihood(logs, middle, at)
        if len(ll) < points:
            break
        top = max(range(points), key=lambda i: ll[at[i]])
        best = at[top]
        if top in (0, points - 1):
            lo, hi = best - (hi - lo) / 2, best + (hi - lo) / 2
            continue
        if step <= width:
            a, b, c_ = (ll[at[top + i]] for i in (-1, 0, 1))
            best += step / 2 * (a - c_) / (a - 2 * b + c_)
            break
        lo, hi = best - step, best + step
    return df.sparkSession.range(1).select(F.lit(best).cast("double").alias("lam"))


# --- ridge over Gram sums ------------------------------------------------------------------


def design(df: DataFrame, numeric: list[str], cats: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Columns z0..zd: the intercept, numerics, one 0/1 column per known category."""
    cols = [F.lit(1.0)] + [c(x).cast("double") for x in numeric]
    cols += [(F.coalesce(F.col(k), F.lit("missing")) == v).cast("double") for k, vs in cats.items() for v in vs]
    names = [f"z{i}" for i in range(len(cols))]
    return df.withColumns(dict(zip(names, cols))), names


def gram(df: DataFrame, by: list[str], names: list[str], y: str, weight: str | None = None) -> DataFrame:
    """Per group the sums of all products of the design columns and the target; a row counts ``weight`` times."""
    v = [*names, y]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    prods = [F.sum(F.col(v[i]) * F.col(v[j]) * w) for i in range(len(v)) for j in range(i, len(v))]
    return df.groupBy(*by).agg(F.array(*prods).alias("g"))


def _square(rows: np.ndarray, d: int) -> np.ndarray:
    """Packed upper triangles to full symmetric matrices."""
    out = np.zeros((len(rows), d, d))
    iu = np.triu_indices(d)
    out[:, iu[0], iu[1]] = rows
    out[:, iu[1], iu[0]] = rows
    return out


def ridge_without(total: np.ndarray, own: np.ndarray, d: int, alpha: float) -> np.ndarray:
    """Coefficients (intercept first) of the fits on everything but each group.

    The penalty leaves the intercept alone: products are centred on the training means.
    """
    g = _square(total[None, :] - own, d + 1)
    n = g[:, 0, 0]
    m = g[:, 0, 1:] / n[:, None]
    centred = g[:, 1:, 1:] - n[:, None, None] * m[:, :, None] * m[:, None, :]
    a = centred[:, :-1, :-1] + alpha * np.eye(d - 1)
    w = np.linalg.solve(a, centred[:, :-1, -1][..., None])[..., 0]
    b0 = m[:, -1] - (m[:, :-1] * w).sum(axis=1)
    return np.concatenate([b0[:, None], w], axis=1)


def ridge_leave_out(grams: DataFrame, key: str, d: int, alpha: float = 1.0) -> DataFrame:
    """Per group the ridge coefficients of its complement.

    Only Gram rows (one per group, fixed length) reach Python; the solve is one numpy
    call per batch.
    """
    size = (d + 1) * (d + 2) // 2
    total = grams.agg(F.array(*[F.sum(F.col("g")[i]) for i in range(size)]).alias("tot"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            w = ridge_without(np.stack(pdf["tot"])[0], np.stack(pdf["g"]), d, alpha)
            yield pd.DataFrame({key: pdf[key], "coef": list(w)})

    kind = dict(grams.dtypes)[key]
    return with_scalar(grams, total).mapInPandas(solve, f"{key} {kind}, coef array<double>")


#: Folds whose coefficients are held at once while all rows are scored by them.
FOLDS = 4096
#: Terms of the series that sums over all rows are expanded in, at most, and the part of the sum it may leave out.
TERMS = 1024
EXACT = 1e-15


def _sums_of(kind: str, lam: float | None) -> Callable:
    """What a row gives to the two sums of a fold, from its target, native value and prediction."""
    back = X.inverse_array(kind, lam)

    def sums(yt: np.ndarray, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if kind == "log1p":
            return np.exp(yt - p), np.ones_like(p)
        return np.broadcast_to(y, p.shape), back(p)

    return sums


def _scored_by_each(rows: DataFrame, folds: DataFrame, key: str, names: list[str], kind: str, lam: float | None) -> DataFrame | None:
    """``(key, a, b)``: every row scored by every fold, ``FOLDS`` of them at a time, in tasks that add up one number pair a fold."""
    sc, sums = rows.sparkSession.sparkContext, _sums_of(kind, lam)
    kind_of = dict(folds.dtypes)[key]
    keys = [r[0] for r in folds.select(key).orderBy(key).collect()]  # one number a fold

    def total(mat: np.ndarray) -> Callable:
        held = sc.broadcast(mat)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top = np.zeros((2, held.value.shape[0]))
            for pdf in batches:
                for i in range(0, len(pdf), 1024):
                    one = pdf.iloc[i : i + 1024]
                    a, b = sums(one["_y"].to_numpy()[:, None], one["_native"].to_numpy()[:, None], one[names].to_numpy() @ held.value.T)
                    top += np.stack([a.sum(0), b.sum(0)])
            yield pd.DataFrame({"i": np.arange(top.shape[1]), "a": top[0], "b": top[1]})

        return run

    out = []
    for lo in range(0, len(keys), FOLDS):
        some = keys[lo : lo + FOLDS]
        coefs = {r[0]: r[1] for r in folds.where(F.col(key).between(some[0], some[-1])).collect()}
        run = total(np.array([coefs[k] for k in some]))
        got = rows.mapInPandas(run, "i long, a double, b double").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        out.append(got.select(F.get(F.lit(some).cast(f"array<{kind_of}>"), F.col("i").cast("int")).alias(key), "a", "b"))
    return reduce(lambda x, z: x.unionByName(z), out) if out else None


def _left_out(kind: str, lam: float | None, terms: int, radius: float) -> float:
    """Bound of what the series of a row's score leaves out after the term of this degree, relative to the score, if predictions move by ``radius`` at most."""
    k = terms + 1
    if kind == "log1p" or not lam:
        return radius**k / math.factorial(k) * math.exp(2 * radius)
    power, rho = 1.0 / lam, abs(lam) * radius * (1.0 if lam > 0 else 2.0)  # scores are expanded where lam p + 1 is 1, or 1 / 2, at least
    binom = math.prod(abs(power - j) / (j + 1) for j in range(k))
    return binom * rho**k * max((1 + rho) ** abs(power), (1 - rho) ** -(k + abs(power))) if rho < 1 else math.inf


def _reach(kind: str, lam: float | None, terms: int) -> float:
    """The largest radius at which the series may end with this degree."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _left_out(kind, lam, terms, mid) <= EXACT else (lo, mid)
    return lo


def _derivatives(kind: str, lam: float | None, yt: np.ndarray, p: np.ndarray, terms: int) -> Iterator[np.ndarray]:
    """A row's score and its derivatives in the prediction, each over the factorial of its order."""
    if kind == "log1p" or not lam:
        sign = -1.0 if kind == "log1p" else 1.0
        e = np.exp(yt - p) if kind == "log1p" else np.exp(p)
        for k in range(terms + 1):
            yield (e if kind == "log1p" or k else np.expm1(p)) * (sign**k / math.factorial(k))
        return
    s, binom = lam * p + 1, 1.0
    for k in range(terms + 1):
        yield binom * lam**k * s ** (1.0 / lam - k) - (0.0 if k else 1.0)
        binom *= (1.0 / lam - k) / (k + 1)


def _powers(x: np.ndarray, terms: int) -> list[np.ndarray]:
    """For each degree the products of that many columns: all monomials of a row of values, and in the same order those of another one."""
    out = [np.ones((len(x), 1))]
    last = [(0, 0)] if x.shape[1] else []  # (first column that may follow, place)
    for _ in range(terms):
        cols, places = [], []
        for low, place in last:
            for j in range(low, x.shape[1]):
                cols.append(out[-1][:, place] * x[:, j])
                places.append((j, len(cols) - 1))
        out.append(np.stack(cols, 1) if cols else np.ones((len(x), 0)))
        last = places
    return out


def _orders(width: int, terms: int) -> list[np.ndarray]:
    """How many orders of its factors each product of ``_powers`` stands for."""
    out = []
    for k, names in enumerate(_monomials(width, terms)):
        out.append(np.array([math.factorial(k) / math.prod(math.factorial(m.count(j)) for j in set(m)) for m in names]))
    return out


def _monomials(width: int, terms: int) -> list[list[tuple[int, ...]]]:
    """The columns in each product of ``_powers``."""
    out: list[list[tuple[int, ...]]] = [[()]]
    for _ in range(terms):
        out.append([(*m, j) for m in out[-1] for j in range(m[-1] if m else 0, width)])
    return out


def fold_factors(rows: DataFrame, fits: DataFrame, key: str, names: list[str], kind: str, lam: float | None) -> DataFrame:
    """``(key, a, b)``: the sums of each fold's bias correction over all rows; the fold's own rows are then taken off.

    log1p: mean of exp(residual); other targets: mean observed over mean predicted in native units. Every row counts for every fold, as the
    definition asks. Folds differ little from each other, so a row's score is a power series in the difference of a fold's coefficients from the middle
    ones, and the sum over rows needs only the sums of its terms, which one pass over the rows makes. The series ends where a bound on its
    rest (``_left_out``) is below the rounding of a sum. Folds too far from the middle, and rows whose score may
    be cut off (at zero, or above) for some fold, are scored one by one.
    """
    folds = settle(fits.select(key, "coef"))
    width, no = len(names), folds.select(key, F.lit(0.0).alias("a"), F.lit(0.0).alias("b")).where("false")
    mid = folds.agg(*[F.percentile_approx(F.col("coef")[i], 0.5, 1000).alias(f"w{i}") for i in range(width)], F.count(F.lit(1)).alias("n")).first()
    top = rows.agg(*[F.max(F.abs(z)).alias(f"s{i}") for i, z in enumerate(names)], F.sum("_native").alias("y"), F.count(F.lit(1)).alias("c")).first()
    terms = max([k for k in range(1, 13) if math.comb(k + width, width) <= TERMS], default=0)
    plain = kind in ("log1p", "boxcox") and terms and mid["n"] and top["c"] and all(x is not None and math.isfinite(x) for x in (*mid, *top))
    if not plain:
        return _scored_by_each(rows, folds, key, names, kind, lam) or no
    w0, scale = np.array([mid[f"w{i}"] for i in range(width)]), np.array([top[f"s{i}"] for i in range(width)])
    moved = sum((F.abs(F.col("coef")[i] - float(w0[i])) * float(scale[i]) for i in range(width)), F.lit(0.0))
    folds = folds.withColumn("_far", F.coalesce(moved, F.lit(float("inf"))))
    reach = _reach(kind, lam, terms)
    near = folds.where(F.col("_far") <= reach)
    radius = near.agg(F.max("_far")).first()[0]
    if radius is None:
        return _scored_by_each(rows, folds, key, names, kind, lam) or no
    terms = next(k for k in range(1, terms + 1) if _left_out(kind, lam, k, radius) <= EXACT or k == terms)
    rows = rows.withColumn("_p0", sum((F.col(z) * float(w0[i]) for i, z in enumerate(names)), F.lit(0.0)))
    calm, cut = rows, None
    if kind == "boxcox" and lam:
        slack = radius * (1 + 1e-9) + 1e-9
        high = lambda p: F.pow(p * F.lit(float(lam)) + 1, F.lit(1.0 / lam)) - 1
        inside = (F.col("_p0") > slack) & (F.col("_p0") * float(lam) + 1 >= 0.5) & (high(F.col("_p0") + F.lit(slack)) < X.NATIVE_MAX)
        inside = F.coalesce(inside, F.lit(False))
        calm, cut = rows.where(inside), rows.where(~inside & ~F.coalesce(F.col("_p0") < -slack, F.lit(False)))
        cut = None if cut.isEmpty() else settle(cut)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = None
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                one = pdf.iloc[i : i + 1024]
                z = one[names].to_numpy() / np.where(scale > 0, scale, 1.0)
                got = [d @ x for d, x in zip(_derivatives(kind, lam, one["_y"].to_numpy(), one["_p0"].to_numpy(), terms), _powers(z, terms))]
                found = got if found is None else [p + q for p, q in zip(found, got)]
        if found is not None:
            flat = np.concatenate(found)
            yield pd.DataFrame({"i": np.arange(len(flat)), "m": flat})

    count = sum(map(len, _monomials(width, terms)))
    sums_ = np.zeros(count)
    for r in calm.mapInPandas(moments, "i long, m double").groupBy("i").agg(F.sum("m").alias("m")).collect():  # at most TERMS numbers
        sums_[r[0]] = r[1]
    sums_ *= np.concatenate(_orders(width, terms))
    total, c_ = float(top["y"]), float(top["c"])

    def series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                one = pdf.iloc[i : i + 1024]
                got = np.concatenate(_powers((np.stack(one["coef"]) - w0) * scale, terms), 1) @ sums_
                a, b = (got, np.full(len(got), c_)) if kind == "log1p" else (np.full(len(got), total), got)
                yield pd.DataFrame({key: one[key], "a": a, "b": b})

    out = near.select(key, "coef").mapInPandas(series, f"{key} {dict(folds.dtypes)[key]}, a double, b double")
    if cut is not None:
        more = _scored_by_each(cut, near.select(key, "coef"), key, names, kind, lam).select(key, F.col("b").alias("_more"))
        out = out.join(more, key).select(key, "a", (F.col("b") + F.col("_more")).alias("b"))
    far = _scored_by_each(rows, folds.where(F.col("_far") > reach).select(key, "coef"), key, names, kind, lam)
    return out if far is None else out.unionByName(far)


def ridge_logo(
    df: DataFrame, site: str, numeric: list[str], cats: dict[str, list[str]], y: str, alpha: float = 1.0, min_test: int = 5, kind: str = "sqrt",
    lam: float | None = None, weight: str | None = None,
) -> DataFrame:
    """Leave-one-site-out ridge on a transformed target (``sqrt``, ``log1p`` or ``boxcox``) with bias correction.

    Missing numerics take the median of all rows before anything is summed, missing categories are a category of their own, rows
    without a target are left out, ``weight`` weighs rows in the fit. Coefficients come from sums, so no fold reads the
    rows of other sites; the correction of sqrt does so too, the others go over the rows in a fixed number of passes (``fold_factors``).
    Metrics per site in model and native space.
    """
    d = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    num = [c(x).cast("double") for x in numeric]
    d = d.withColumns({x: F.when(~F.isnan(e), e) for x, e in zip(numeric, num)})
    if numeric:
        d = with_scalar(d, quantiles(d, [], {f"_med_{x}": (x, 0.5) for x in numeric}))
        d = d.withColumns({x: F.coalesce(x, f"_med_{x}") for x in numeric}).drop(*[f"_med_{x}" for x in numeric])
    d, names = design(d, numeric, cats)
    d = d.withColumn("_native", clip(y, 0.0)).withColumn("_y", X.forward("_native", kind, lam))
    fits = ridge_leave_out(gram(d, [site], names, "_y", weight), site, len(names), alpha)
    if kind == "sqrt":
        own = gram(d, [site], names, "_y")
        factor = ratio_factors(own, fits, site, len(names))
    else:
        rows = d.select(site, "_y", "_native", *names)
        all_ = fold_factors(rows, fits, site, names, kind, lam)
        mine = spread_join(rows, fits, [site]).withColumn("_p", _predicted(names))
        a, b = (F.exp(F.col("_y") - F.col("_p")), F.lit(1.0)) if kind == "log1p" else (F.col("_native"), X.inverse("_p", kind, lam))
        mine = mine.groupBy(site).agg(F.sum(a).alias("_a"), F.sum(b).alias("_b"))
        factor = all_.join(mine, site).select(site, ((F.col("a") - F.col("_a")) / F.nullif(F.col("b") - F.col("_b"), F.lit(0.0))).alias("factor"))
    fits = fits.join(factor, site)
    s = spread_join(d, fits, [site]).withColumn("_p", _predicted(names))
    s = s.withColumn("_pn", clip(X.inverse("_p", kind, lam) * F.col("factor"), 0.0))
    a = M.site_skill(s, [site], "_y", "_p", ["n", "r2", "kge"])
    b = M.site_skill(s, [site], "_native", "_pn", ["r2", "rmse", "pbias"]).withColumnsRenamed({x: f"{x}_native" for x in ("r2", "rmse", "pbias")})
    return a.where(F.col("n") >= min_test).join(b, site).join(fits.select(site, "factor"), site)


def _predicted(names: list[str]) -> Column:
    return sum((F.col(z) * F.col("coef")[i] for i, z in enumerate(names)), F.lit(0.0))


def ratio_factors(grams: DataFrame, fits: DataFrame, key: str, d: int) -> DataFrame:
    """``(key, factor)``: sum(y^2) / sum(p^2) over each group's complement, both from Gram sums."""
    size = (d + 1) * (d + 2) // 2
    total = grams.agg(F.array(*[F.sum(F.col("g")[i]) for i in range(size)]).alias("tot"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            full = _square(np.stack(pdf["tot"]) - np.stack(pdf["g"]), d + 1)
            w = np.stack(pdf["coef"])
            yield pd.DataFrame({key: pdf[key], "factor": full[:, -1, -1] / np.einsum("ni,nij,nj->n", w, full[:, :-1, :-1], w)})

    return with_scalar(grams.join(fits, key), total).mapInPandas(solve, f"{key} {dict(grams.dtypes)[key]}, factor double")
