"""Breakdowns of skill by regime, importance tables, applicability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions import normalize as N, transforms as X
from freshet.functions.basics import by_keys, clip, value_block, with_scalar
from freshet.operators import metrics as M
from freshet.operators.blocks import medians, ordered, quantiles

PACK = ["n", "r2", "rmse", "mape_pct", "within_2x_pct", "mean_true", "mean_pred", "median_abs_error", "bias_pct"]


def pack(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """The metric pack on pairs where both values exist; NULL metrics below two rows."""
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    q = F.when(F.col(y) > 0, F.col(p) / F.nullif(F.col(y), F.lit(0.0)))
    g = d.groupBy(*by).agg(*M.base_sums(y, p), F.avg(q.between(0.5, 2.0).cast("double")).alias("_w2"))
    rep = M._report()
    tot = F.col("_vy") * F.col("_n")
    g = g.select(
        *by, F.col("_n").alias("n"), F.when(tot > M.TINY, 1 - F.col("_sse") / F.nullif(tot, F.lit(0.0))).alias("r2"),
        rep["rmse"].alias("rmse"), (F.col("_w2") * 100).alias("within_2x_pct"), rep["mean_true"].alias("mean_true"),
        rep["mean_pred"].alias("mean_pred"), rep["bias_pct"].alias("bias_pct"),
    )
    err = F.abs(F.col(y) - F.col(p))
    med = medians(d.select(*by, F.when(F.col(y) > 0, err / F.nullif(F.col(y), F.lit(0.0)) * 100).alias("_a"), err.alias("_e")), by,
                  mape_pct="_a", median_abs_error="_e")
    j = by_keys(g, med, by, "left")
    few = F.col("n") < 2
    return j.select(*by, "n", *[F.when(~few, F.col(x)).alias(x) for x in PACK[1:]])


def long_groups(df: DataFrame, dims: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per (row, dimension) whose value exists; the list of dimensions is fixed."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("group")) for d, v in dims.items()])
    return df.select(*keep, F.inline(pairs)).where(F.col("group").isNotNull())


def disaggregate(df: DataFrame, site: str, y: str, p: str, turb: str, plain: dict[str, str]) -> DataFrame:
    """Metric pack for every value of every dimension, in one grouping."""
    per = df.groupBy(site).agg(F.stddev_samp(y).alias("_std"), F.count("*").alias("_ns"))
    per = X.quantile_bins(per, "_std", ["Q1_low", "Q2_med", "Q3_high", "Q4_extreme"], "_var")
    d = df.join(per.select(site, "_var", "_ns"), site, "left")
    dims = {
        "overall": F.lit("ALL"), **{k: F.col(v) for k, v in plain.items()}, "variability": F.col("_var"),
        "sample_count": X.bin_right("_ns", [0, 10, 20, 50, 200, float("inf")], ["1-10", "11-20", "21-50", "51-200", "200+"]),
        "turb_tier": X.bin_right(turb, [0, 10, 50, 200, 1000, float("inf")], ["<10", "10-50", "50-200", "200-1000", ">1000"]),
        "conc_tier": X.bin_right(y, [0, 50, 500, 5000, float("inf")], ["low", "med", "high", "extreme"]),
    }
    return pack(long_groups(d, dims, [y, p]), ["dimension", "group"], y, p)


def contrast(df: DataFrame, group: str, y: str, p: str, turb: str) -> DataFrame:
    """Metric pack, concentration-to-turbidity ratio (observed, predicted) and median bias per group."""
    t = clip(turb, 1.0)
    d = df.where(F.col(group).isNotNull())
    m = medians(d.select(group, (F.col(y) / t).alias("_o"), (F.col(p) / t).alias("_q"), (F.col(p) - F.col(y)).alias("_b")), [group],
                ratio_obs="_o", ratio_pred="_q", median_bias="_b")
    return pack(d, [group], y, p).join(m, group)


def first_flush(df: DataFrame, dry: str, flush: str) -> DataFrame:
    """Driest quarter and strongest quarter together, against the rest."""
    q = quantiles(df, [], {"_d": (dry, 0.25), "_f": (flush, 0.75)})
    d = with_scalar(df, q)
    hit = (F.col(dry) <= F.col("_d")) & (F.col(flush) >= F.col("_f"))
    return d.withColumn("group", F.when(F.coalesce(hit, F.lit(False)), "flush").otherwise("normal")).drop("_d", "_f")


def extremes(df: DataFrame, turb: str) -> DataFrame:
    """Overlapping groups: top 1 %, top 5 %, the other 95 %."""
    d = with_scalar(df, quantiles(df, [], {"_a": (turb, 0.99), "_b": (turb, 0.95)}))
    t = F.col(turb)
    tags = F.array(F.when(t >= F.col("_a"), "top1"), F.when(t >= F.col("_b"), "top5"), F.when(t < F.col("_b"), "bottom95"))
    return d.withColumn("group", F.explode(F.filter(tags, lambda x: x.isNotNull()))).drop("_a", "_b")


def quartile_contrast(df: DataFrame, value: str, high: str, low: str) -> DataFrame:
    """Upper quartile against lower quartile; the middle half is left out."""
    d = with_scalar(df, quantiles(df, [], {"_h": (value, 0.75), "_l": (value, 0.25)}))
    return d.withColumn("group", F.when(F.col(value) >= F.col("_h"), high).when(F.col(value) < F.col("_l"), low)).drop("_h", "_l")


def site_picks(skill: DataFrame, site: str, value: str, levels: dict[str, float]) -> DataFrame:
    """Sites whose skill is nearest to given quantiles."""
    q = quantiles(skill, [], {k: (value, p) for k, p in levels.items()})
    d = with_scalar(skill, q)
    near = d.agg(*[F.min(F.struct(F.abs(F.col(value) - F.col(k)).alias("d"), F.col(value).alias("v"), F.col(site).alias("s"))).alias(k) for k in levels])
    return near.select(F.inline(F.array(*[F.struct(F.lit(k).alias("pick"), F.col(k)["s"].alias(site), F.col(k)["v"].alias(value)) for k in levels])))


def third_picks(skill: DataFrame, site: str, value: str, n: str, min_n: int = 5) -> DataFrame:
    """Best and worst site of the top, middle and bottom third by skill."""
    d = skill.where(F.col(n) >= min_n).withColumn("_neg", -F.col(value))
    d = ordered(d, [], ["_neg", site], value_block("_neg"), number="rn", total="_m")
    k = F.greatest(F.floor(F.col("_m") / 3), F.lit(1))
    part = F.when(F.col("rn") <= k, "top").when(F.col("rn") > F.col("_m") - k, "bottom").otherwise("middle")
    ends = [F.lit(1), k, k + 1, F.col("_m") - k, F.col("_m") - k + 1, F.col("_m")]
    hit = ends[0] == F.col("rn")
    for e in ends[1:]:
        hit = hit | (F.col("rn") == e)
    return d.where(hit).select(site, value, "rn", part.alias("third"))


def funnel(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Distinct entities left at every stage and lost since the one before."""
    out, before = None, None
    for i, (name, df) in enumerate(stages.items()):
        n = df.agg(F.countDistinct(key).alias("n_sites")).withColumn("stage", F.lit(name)).withColumn("step", F.lit(i))
        if before is not None:
            n = with_scalar(n, before.select(F.col("n_sites").alias("_b"))).withColumn("lost", F.col("_b") - F.col("n_sites")).drop("_b")
        else:
            n = n.withColumn("lost", F.lit(0).cast("long"))
        out, before = (n if out is None else out.unionByName(n)), n
    return out


def attribution_long(df: DataFrame, keep: list[str], cols: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("feature"), F.abs(F.col(x)).alias("a")) for x, name in cols.items()])
    return df.select(*keep, F.inline(pairs))


def importance(df: DataFrame, cols: dict[str, str], top: int = 15) -> DataFrame:
    g = attribution_long(df, [], cols).groupBy("feature").agg(F.avg("a").alias("mean_abs"))
    return g.withColumn("category", N.feature_category("feature")).orderBy(F.desc("mean_abs"), "feature").limit(top)


def importance_by(df: DataFrame, cols: dict[str, str], group: str, min_n: int, scaled: bool = False) -> DataFrame:
    """Mean absolute attribution per feature and group of at least ``min_n`` rows; ``scaled``
    adds its share of the feature's largest group."""
    long = attribution_long(df.where(F.col(group).isNotNull()), [group], cols)
    g = long.groupBy(group, "feature").agg(F.avg("a").alias("mean_abs"), F.count("*").alias("n")).where(F.col("n") >= min_n)
    if not scaled:
        return g
    top = g.groupBy("feature").agg(F.max("mean_abs").alias("_mx"))
    share = F.when(F.col("_mx") == 0, 0.0).otherwise(F.col("mean_abs") / F.nullif(F.col("_mx"), F.lit(0.0)))
    return g.join(top, "feature").withColumn("share", share).drop("_mx")


# --- applicability ------------------------------------------------------------------------

TIERS = {"high": 0.7, "moderate": 0.4, "low": 0.1}  # fixed values: lowest score per tier


def category_counts(df: DataFrame, train: DataFrame, site: str, cats: list[str]) -> DataFrame:
    """Per site how many training sites share each category value (0 if never seen)."""
    out = df
    for x in cats:
        seen = train.groupBy(x).agg(F.count("*").alias(f"n_{x}"))
        out = out.join(seen, x, "left").withColumn(f"n_{x}", F.coalesce(f"n_{x}", F.lit(0)))
    return out


def categorical_score(cats: list[str]) -> Column:
    """1 when every category value was seen in training or is missing, else 0."""
    ok = F.lit(1.0)
    for x in cats:
        ok = F.least(ok, F.when(F.col(x).isNull() | (F.col(f"n_{x}") > 0), 1.0).otherwise(0.0))
    return ok


def regime_score(cats: list[str]) -> Column:
    s = F.lit(1.0)
    for x in cats:
        s = F.least(s, F.when(F.col(x).isNotNull(), F.least(F.col(f"n_{x}") / 5.0, F.lit(1.0))).otherwise(1.0))
    return s


def range_bounds(train: DataFrame, features: list[str]) -> DataFrame:
    return train.agg(*[F.min(x).alias(f"_lo_{x}") for x in features], *[F.max(x).alias(f"_hi_{x}") for x in features])


def range_score(features: list[str]) -> Column:
    """Share of present features within the training range widened by a tenth."""
    def inside(x: str) -> Column:
        m = (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * 0.1
        return F.col(x).between(F.col(f"_lo_{x}") - m, F.col(f"_hi_{x}") + m)

    have = sum((F.col(x).isNotNull().cast("int") for x in features), F.lit(0))
    good = sum((F.coalesce(inside(x), F.lit(False)).cast("int") for x in features), F.lit(0))
    return F.when(have == 0, 1.0).otherwise(good / F.nullif(have, F.lit(0)))


def correlation_score(df: DataFrame, site: str, x: str, y: str, min_n: int = 10) -> DataFrame:
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(site).agg(F.count("*").alias("n_pairs"), M.guarded_corr(x, y).alias("corr"))
    s = F.least(F.greatest(F.col("corr") / 0.5, F.lit(0.0)), F.lit(1.0))
    return g.withColumn("corr_score", F.when(F.col("n_pairs") < min_n, 0.5).otherwise(s))


def applicability(df: DataFrame, train: DataFrame, site: str, cats: list[str], features: list[str], corr: DataFrame | None = None) -> DataFrame:
    """Worst sub-score, its tier and the warnings, per site."""
    d = with_scalar(category_counts(df, train, site, cats), range_bounds(train, features))
    d = d.withColumns({"categorical_coverage": categorical_score(cats), "regime_density": regime_score(cats), "feature_ranges": range_score(features)})
    subs = ["categorical_coverage", "regime_density", "feature_ranges"]
    if corr is not None:
        d, subs = d.join(corr.select(site, "corr_score", "corr"), site, "left"), [*subs, "corr_score"]
    d = d.withColumn("score", F.least(*[F.coalesce(F.col(x), F.lit(1.0)) for x in subs]))
    tier = F.lit("not_applicable")
    for name, lo in sorted(TIERS.items(), key=lambda x: x[1]):
        tier = F.when(F.col("score") >= lo, name).otherwise(tier)
    notes = [F.when(F.col(x).isNotNull() & (F.col(f"n_{x}") == 0), F.concat(F.lit(f"unknown {x}"))) for x in cats]
    notes += [F.when(F.col(x).isNotNull() & (F.col(f"n_{x}") < 3), F.lit(f"sparse {x}")) for x in cats]
    notes.append(F.when(F.col("feature_ranges") < 1, F.lit("out of range")))
    if corr is not None:
        notes.append(F.when(F.col("corr") < 0.3, F.lit("low correlation")))
    return d.select(site, *subs, "score", tier.alias("tier"), F.array_join(F.filter(F.array(*notes), lambda x: x.isNotNull()), "; ").alias("warnings"))
