"""Prediction intervals from residual quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions import transforms as X
from freshet.functions.basics import by_keys, clip, settle, with_scalar
from freshet.operators.blocks import medians, quantiles

# fixed values: bins of predicted concentration, [low, high)
BIN_EDGES = [0, 30, 100, 500, 2000]
BIN_LABELS = ["0-30", "30-100", "100-500", "500-2000", "2000+"]
RELIABLE_N = 50


def pred_bin(p: str) -> Column:
    return X.bin_left(p, BIN_EDGES, BIN_LABELS)


def mondrian_fit(cal: DataFrame, y: str, p: str, alphas: tuple[float, ...] = (0.1, 0.2)) -> DataFrame:
    """Residual percentiles per bin of the prediction (at most one row per bin)."""
    d = cal.select(pred_bin(p).alias("bin"), (F.col(y) - F.col(p)).alias("_r")).where("bin is not null")
    spec = {}
    for a in alphas:
        tag = int(round((1 - a) * 100))
        spec |= {f"lo{tag}": ("_r", a / 2), f"hi{tag}": ("_r", 1 - a / 2)}
    q = quantiles(d, ["bin"], spec)
    m = medians(d.withColumn("_a", F.abs("_r")), ["bin"], median_abs_residual="_a")
    n = d.groupBy("bin").agg(F.count("*").alias("n_calibration"))
    return q.join(m, "bin").join(n, "bin").withColumn("reliable", F.col("n_calibration") >= RELIABLE_N)


def mondrian_apply(df: DataFrame, bounds: DataFrame, y: str, p: str, tag: int = 90) -> DataFrame:
    """Bounds, coverage flag and width per row; the bound table has one row per bin."""
    b = bounds.select("bin", F.col(f"lo{tag}").alias("_lo"), F.col(f"hi{tag}").alias("_hi"))
    d = df.withColumn("bin", pred_bin(p)).join(F.broadcast(b), "bin", "left")
    return covered(d.withColumn("lower", clip(F.col(p) + F.col("_lo"), 0)).withColumn("upper", F.col(p) + F.col("_hi")).drop("_lo", "_hi"), y)


def covered(df: DataFrame, y: str) -> DataFrame:
    return df.withColumn("covered", F.col(y).between(F.col("lower"), F.col("upper"))).withColumn("width", F.col("upper") - F.col("lower"))


def coverage(df: DataFrame, by: str) -> DataFrame:
    """Coverage and widths per group and overall, in one grouping."""
    d = df.where(F.col("lower").isNotNull() & F.col("upper").isNotNull())
    pair = F.array(F.lit("ALL"), F.col(by))
    d = d.select(F.explode(pair).alias(by), "covered", "width").where(F.col(by).isNotNull())
    g = d.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("width").alias("mean_width"))
    return g.join(medians(d, [by], median_width="width"), by)


def knots(cal: DataFrame, y: str, p: str, n: int = 20, half: float = 0.075, few: int = 20, nearest: int = 200) -> DataFrame:
    """Knots at evenly spaced quantiles of the prediction with local residual percentiles.

    A knot's window is the quantile band around it; a band with too few rows takes the
    nearest rows instead. Rows meet the short knot list as an array and only go to the
    bands they lie in.
    """
    levels = [0.01 + i * 0.98 / (n - 1) for i in range(n)]
    spec = {}
    for i, q in enumerate(levels):
        spec |= {f"x{i}": (p, q), f"a{i}": (p, max(0.0, q - half)), f"b{i}": (p, min(1.0, q + half))}
    one = quantiles(cal, [], spec)
    arr = F.array(*[F.struct(F.lit(i).alias("knot"), F.col(f"x{i}").alias("x"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i in range(n)])
    ks = settle(one.select(arr.alias("_ks")))
    rows = with_scalar(cal.select(F.col(p).alias("_p"), (F.col(y) - F.col(p)).alias("_r")), ks)
    band = rows.select("_r", F.explode(F.filter("_ks", lambda k: (F.col("_p") >= k["a"]) & (F.col("_p") <= k["b"]))).alias("k"))
    band = band.select("_r", "k.knot")
    n_in = band.groupBy("knot").agg(F.count("*").alias("_n"))
    full = ks.select(F.inline("_ks")).join(n_in, "knot", "left")
    thin = full.where(F.coalesce("_n", F.lit(0)) < few).agg(F.collect_list(F.struct("knot", "x")).alias("_thin"))  # at most n entries
    far = with_scalar(rows.drop("_ks"), thin).select("_p", "_r", F.explode("_thin").alias("k"))
    far = far.select("_r", "k.knot", F.abs(F.col("_p") - F.col("k.x")).alias("_d"))
    near = far.withColumn("_rn", F.row_number().over(W.partitionBy("knot").orderBy("_d", "_r"))).where(F.col("_rn") <= nearest).select("_r", "knot")
    local = band.join(F.broadcast(n_in.where(F.col("_n") >= few).select("knot")), "knot", "left_semi").select("_r", "knot").unionByName(near)
    q = quantiles(local, ["knot"], {"lo90": ("_r", 0.05), "hi90": ("_r", 0.95), "lo80": ("_r", 0.1), "hi80": ("_r", 0.9)})
    size = local.groupBy("knot").agg(F.count("*").alias("n_local"))
    return full.select("knot", "x").join(q, "knot").join(size, "knot")


def interpolate(x: str | Column, arr: str, xf: str, yf: str) -> Column:
    """Piecewise-linear lookup in a sorted array of structs, flat beyond the ends."""
    v = F.col(x) if isinstance(x, str) else x
    ks = F.col(arr)
    below = F.filter(ks, lambda k: k[xf] <= v)
    above = F.filter(ks, lambda k: k[xf] > v)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    line = a[yf] + (b[yf] - a[yf]) * (v - a[xf]) / (b[xf] - a[xf])
    return F.when(F.size(below) == 0, b[yf]).when(F.size(above) == 0, a[yf]).otherwise(line)


def continuous_bounds(df: DataFrame, knot_table: DataFrame, y: str, p: str, tag: int = 90) -> DataFrame:
    """Bounds from interpolated offsets; the knots travel as one short array."""
    ks = knot_table.agg(F.array_sort(F.collect_list(F.struct("x", F.col(f"lo{tag}").alias("lo"), F.col(f"hi{tag}").alias("hi")))).alias("_ks"))
    d = with_scalar(df, ks)
    d = d.withColumn("lower", clip(F.col(p) + interpolate(p, "_ks", "x", "lo"), 0)).withColumn("upper", F.col(p) + interpolate(p, "_ks", "x", "hi"))
    return covered(d.drop("_ks"), y)


def split_bounds(cal: DataFrame, df: DataFrame, y: str, p: str, alphas: tuple[float, ...] = (0.05, 0.1)) -> DataFrame:
    """Global residual quantiles in log space, back-transformed, per level."""
    spec = {}
    for a in alphas:
        t = int(round((1 - a) * 100))
        spec |= {f"_l{t}": ("_res", a / 2), f"_h{t}": ("_res", 1 - a / 2)}
    q = quantiles(cal.select((F.log1p(y) - F.log1p(p)).alias("_res")), [], spec)
    d = with_scalar(df, q)
    for a in alphas:
        t = int(round((1 - a) * 100))
        d = d.withColumn(f"lower{t}", clip(F.expm1(F.log1p(p) + F.col(f"_l{t}")), 0)).withColumn(f"upper{t}", F.expm1(F.log1p(p) + F.col(f"_h{t}")))
    return d.drop(*spec)


def interval_metrics(df: DataFrame, by: list[str], y: str, lower: str, upper: str) -> DataFrame:
    width = F.col(upper) - F.col(lower)
    d = df.select(*by, F.col(y).between(F.col(lower), F.col(upper)).cast("double").alias("_in"), width.alias("_w"),
                  F.when(F.col(y) > 0, width / F.nullif(F.col(y), F.lit(0.0))).alias("_wr"))
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_in").alias("coverage"), F.avg("_w").alias("mean_width"), F.avg("_wr").alias("mean_ratio"))
    return by_keys(g, medians(d, by, median_width="_w", median_ratio="_wr"), by)


def conformity(lo: str, hi: str, y: str) -> Column:
    return F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))


def conformal_level(alpha: float):
    """ceil((n + 1)(1 - alpha)) / n, at most 1, as a function of the count."""
    return lambda n: F.least(F.ceil((n + 1) * F.lit(1 - alpha)) / n, F.lit(1.0))


def q_hat(scores: DataFrame, score: str, alpha: float, out: str = "q_hat") -> DataFrame:
    return quantiles(scores, [], {out: (score, conformal_level(alpha))})


def conformalize(df: DataFrame, lo: str, hi: str, y_ms: str, alpha: float, lam: float) -> DataFrame:
    """Intervals widened by the conformal threshold, in model and native space."""
    s = df.withColumn("_s", conformity(lo, hi, y_ms))
    d = with_scalar(df, q_hat(s, "_s", alpha))
    d = d.withColumn("lower_ms", F.col(lo) - F.col("q_hat")).withColumn("upper_ms", F.col(hi) + F.col("q_hat"))
    return d.withColumn("lower", X.inverse("lower_ms", "boxcox", lam)).withColumn("upper", X.inverse("upper_ms", "boxcox", lam))


def conditional_coverage(df: DataFrame, by: str, y: str, min_n: int = 10) -> DataFrame:
    inside = F.col(y).between(F.col("lower"), F.col("upper")).cast("double")
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(inside).alias("coverage"))
    return g.where(F.col("n") >= min_n)


def rearrange(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sort crossing quantile columns within each row."""
    s = F.array_sort(F.array(*cols))
    d = df.withColumn("_q", s)
    return d.select(*[F.col("_q")[cols.index(x)].alias(x) if x in cols else F.col(x) for x in df.columns])
