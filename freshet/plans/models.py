"""Cross-site models: preparation, MLlib pipelines, validation, metadata, scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Observation, functions as F

from freshet.functions import transforms as X
from freshet.functions.basics import clip, settle, with_scalar
from freshet.operators import joins, metrics as M, sampling as S
from freshet.operators.blocks import keep_first, medians, quantiles


# --- selection and preparation --------------------------------------------------------------


def choose(all_features: list[str], keep: list[str] | None = None, drop: list[str] | None = None) -> list[str]:
    """Ordered feature list after an optional reduced set and drop list."""
    out = [x for x in all_features if keep is None or x in keep]
    return [x for x in out if x not in (drop or [])]


def select_features(df: DataFrame, ordered_features: list[str], categorical: list[str], carry: list[str]) -> DataFrame:
    """Features in contract order; a missing or all-NULL one is an error, categorical NULL is `missing`."""
    missing = [x for x in ordered_features if x not in df.columns]
    if missing:
        raise ValueError(f"missing features {missing}")
    have = df.agg(*[F.count(x).alias(x) for x in ordered_features]).first()
    empty = [x for x in ordered_features if have[x] == 0]
    if empty:
        raise ValueError(f"features without any value {empty}")
    cols = [F.coalesce(F.col(x).cast("string"), F.lit("missing")).alias(x) if x in categorical else F.col(x) for x in ordered_features]
    return df.select(*carry, *cols)


def prepare(
    paired: DataFrame, split: DataFrame, basic: DataFrame, shed: DataFrame, features: list[str], categorical: list[str],
    kind: str, lam: float | None, role: str = "training", uid: str = "oid",
) -> tuple[DataFrame, DataFrame]:
    """load, split, transform, tier, clean, dedupe, order - with the row count of each step (``step, stage, n_rows``).

    The counts are observed in the job that writes the prepared rows; no step runs a second time for them.
    """
    seen: list[tuple[str, Observation]] = []

    def observed(d: DataFrame, stage: str) -> DataFrame:
        seen.append((stage, Observation(stage)))
        return d.observe(seen[-1][1], F.count(F.lit(1)).alias("n_rows"))

    chosen = observed(joins.by_role(observed(paired, "loaded"), split, "site", role), "split").withColumn("target", X.forward("y", kind, lam))
    tier = observed(joins.feature_tiers(chosen, basic, shed)["C"], "merged")
    clean = settle(observed(keep_first(tier.where("target is not null"), ["site", "time"], [uid]), "selected"))
    counts = [(i, stage, o.get["n_rows"]) for i, (stage, o) in enumerate(seen)]
    out = select_features(clean, features, categorical, ["site", "time", "y", "target"])
    return out.orderBy("site", "time"), paired.sparkSession.createDataFrame(counts, "step int, stage string, n_rows long")


# --- pipelines ------------------------------------------------------------------------------


def boosted(numeric: list[str], categorical: list[str], target: str, **params) -> Pipeline:
    """Median imputation, indexed categories (unseen ones keep a slot), gradient-boosted trees."""
    filled = [f"{x}_filled" for x in numeric]
    index = [f"{x}_index" for x in categorical]
    stages = [Imputer(inputCols=numeric, outputCols=filled, strategy="median")]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*filled, *index], outputCol="_features"))
    stages.append(GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="pred_ms", seed=42, **params))
    return Pipeline(stages=stages)


def linear(features: list[str], target: str) -> Pipeline:
    va = VectorAssembler(inputCols=features, outputCol="_features")
    return Pipeline(stages=[va, LinearRegression(featuresCol="_features", labelCol=target, predictionCol="pred_ms", solver="normal", standardization=False)])


def train_final(df: DataFrame, pipe: Pipeline, site: str, y: str, kind: str, lam: float | None, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Fit on 85 % of the sites; the others give the clipped median correction factor (one row)."""
    d = settle(S.group_shuffle(df, site, seed))  # boosting reads it once per level
    model = pipe.fit(d.where("is_train"))
    val = model.transform(d.where("not is_train"))
    native = F.greatest(X.inverse("pred_ms", kind, lam), F.lit(1e-6))
    q = medians(val.select((F.col(y) / native).alias("_q")), [], _m="_q")
    return model, q.select(clip("_m", 0.5, 3.0).alias("factor"))


def score(df: DataFrame, model: PipelineModel, factor: DataFrame, y: str, kind: str, lam: float | None, carry: list[str]) -> DataFrame:
    """Predictions in model and native space with absolute and percent error."""
    d = with_scalar(model.transform(df), factor)
    pred = clip(X.inverse("pred_ms", kind, lam), 0) * F.col("factor")
    d = d.withColumn("pred_native", pred)
    err = F.abs(F.col(y) - F.col("pred_native"))
    return d.select(*carry, F.col(y), "pred_ms", "pred_native", err.alias("abs_error"),
                    F.when(F.col(y) > 0, err / F.nullif(F.col(y), F.lit(0.0)) * 100).alias("pct_error"))


def grouped_cv(df: DataFrame, pipe: Pipeline, site: str, target: str, y: str, kind: str, lam: float | None, folds: int = 5, min_test: int = 5) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and fold metrics over site folds.

    The number of folds is a parameter; each fold is one distributed fit.
    """
    d = settle(df.join(S.balanced_folds(df, site, target, folds).select(site, "fold"), site))
    parts = []
    for k in range(folds):
        model = pipe.fit(d.where(F.col("fold") != k))
        train = model.transform(d.where(F.col("fold") != k))
        if kind == "log1p":
            f = train.agg(F.avg(F.exp(F.col(target) - F.col("pred_ms"))).alias("factor"))
        else:
            f = train.agg((F.avg(y) / F.avg(X.inverse("pred_ms", kind, lam))).alias("factor"))
        parts.append(with_scalar(model.transform(d.where(F.col("fold") == k)), f).select(site, "fold", target, y, "pred_ms", "factor"))
    oof = reduce(lambda a, b: a.unionByName(b), parts)
    oof = settle(oof.withColumn("pred_native", clip(X.inverse("pred_ms", kind, lam), 0) * F.col("factor")))
    a = M.site_skill(oof, ["fold"], target, "pred_ms", ["n", "r2", "kge"])
    b = M.site_skill(oof, ["fold"], y, "pred_native", ["r2", "rmse", "pbias"]).withColumnsRenamed({x: f"{x}_native" for x in ("r2", "rmse", "pbias")})
    return oof, a.where(F.col("n") >= min_test).join(b, "fold")


def multi_linear(df: DataFrame, site: str, features: list[str], y: str, train: str, min_test: int = 3) -> DataFrame:
    """Least squares over all features on the training rows; test R2 per site and for ALL."""
    d = df.select(F.col(site).cast("string").alias(site), train, *features, y)
    model = linear(features, y).fit(d.where(F.col(train)))
    test = model.transform(d.where(~F.col(train)))
    g = test.rollup(site).agg(*M.base_sums(y, "pred_ms")).where(F.col("_n") >= min_test)
    return g.select(F.coalesce(site, F.lit("ALL")).alias(site), F.col("_n").alias("n_test"), M.r2().alias("r2"))


# --- metadata -------------------------------------------------------------------------------


def metadata(df: DataFrame, site: str, numeric: list[str], categorical: list[str], classes: list[str]) -> DataFrame:
    """Long table: range and median of numerics, seen values of categories, sites per class."""
    pairs = F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("double").alias("v")) for x in numeric])
    long = df.select(F.inline(pairs)).where("v is not null")
    rng = long.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).join(medians(long, ["name"], median="v"), "name")
    num = rng.select(F.lit("range").alias("kind"), "name", F.lit(None).cast("string").alias("value"), "lo", "hi", "median", F.lit(None).cast("long").alias("n_sites"))

    def listed(kind: str, cols: list[str]) -> DataFrame:
        p = F.array(*[F.struct(F.lit(x).alias("name"), F.coalesce(F.col(x).cast("string"), F.lit("missing")).alias("value")) for x in cols])
        one = df.select(site, F.inline(p)).groupBy("name", "value", site).agg(F.count("*").alias("_c"))
        return one.groupBy("name", "value").agg(F.count("*").alias("n_sites")).withColumn("kind", F.lit(kind))

    seen = listed("category", categorical).drop("n_sites")
    return num.unionByName(seen, allowMissingColumns=True).unionByName(listed("class", classes), allowMissingColumns=True)


# --- tables about models --------------------------------------------------------------------


def score_external(ext: DataFrame, sites: DataFrame, train: DataFrame, model: PipelineModel, factor: DataFrame, ext_id: str, attr: list[str], max_deg: float, kind: str, lam: float | None) -> DataFrame:
    """Sparse external rows: attributes from the nearest known site, else the training median."""
    near = joins.nearest_geo(ext.select(ext_id, "lat", "lon").distinct(), sites, ext_id, "site", max_deg)
    d = ext.join(near, ext_id, "left").join(sites.select("site", *attr), "site", "left")
    med = quantiles(train, [], {f"_m_{x}": (x, 0.5) for x in attr})
    d = with_scalar(d, med)
    d = d.withColumns({x: F.coalesce(x, f"_m_{x}") for x in attr}).drop(*[f"_m_{x}" for x in attr])
    return score(d, model, factor, "y", kind, lam, [ext_id, F.col("site").isNotNull().alias("matched")])


def ablation(results: DataFrame, label: str, base: str, cols: list[str], order: str) -> DataFrame:
    """Metric differences of every run to the baseline run, ordered."""
    b = results.where(F.col(label) == base).select(*[F.col(x).alias(f"_b_{x}") for x in cols])
    d = with_scalar(results.where(F.col(label) != base), b)
    return d.select(label, *cols, *[(F.col(x) - F.col(f"_b_{x}")).alias(f"d_{x}") for x in cols]).orderBy(f"d_{order}", label)


def subset_effect(members: DataFrame, scores: DataFrame, sites: DataFrame, subset: str, site: str, value: str) -> DataFrame:
    """Mean score of subsets with a site minus without it: the rest is total minus own, so
    sites never meet the subsets they are not in."""
    tot = scores.agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    own = members.join(scores, subset).groupBy(site).agg(F.count(value).alias("n_with"), F.sum(value).alias("_w"))
    d = with_scalar(sites.select(site).distinct().join(own, site, "left").fillna({"n_with": 0, "_w": 0.0}), tot)
    n_out = F.col("_n") - F.col("n_with")
    w, o = F.col("_w") / F.nullif(F.col("n_with"), F.lit(0)), (F.col("_s") - F.col("_w")) / F.nullif(n_out, F.lit(0))
    return d.select(site, "n_with", n_out.alias("n_without"), w.alias("mean_with"), o.alias("mean_without"), (w - o).alias("effect"))


def anchor_rate(members: DataFrame, scores: DataFrame, sites: DataFrame, run: str, site: str, value: str) -> DataFrame:
    """Share of a site's runs that beat the median run, minus the overall share of such runs."""
    w = with_scalar(scores, medians(scores, [], _med=value)).withColumn("won", (F.col(value) > F.col("_med")).cast("int"))
    base = w.agg(F.avg(F.col("won").cast("double")).alias("_base"))
    g = members.join(w.select(run, "won"), run).groupBy(site).agg(F.count("*").alias("n_runs"), F.sum("won").alias("n_won"))
    d = with_scalar(sites.select(site).distinct().join(g, site, "left").fillna({"n_runs": 0, "n_won": 0}), base)
    rate = F.col("n_won") / F.greatest("n_runs", F.lit(1))
    return d.select(site, "n_runs", "n_won", rate.alias("win_rate"), (rate - F.col("_base")).alias("anchor_score"))
