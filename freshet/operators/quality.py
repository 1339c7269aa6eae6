"""Data-quality checks, lineage and qualification tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.basics import spread_join, with_scalar
from freshet.operators.blocks import medians


def completeness(df: DataFrame) -> DataFrame:
    """Percent of non-NULL values per column, from one pass."""
    n = F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double")
    one = df.agg(*[(F.count(F.col(x)) / n * 100).alias(x) for x in df.columns])
    return one.unpivot([], one.columns, "col", "pct_complete")


def _verdicts(one: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One-row aggregates to (check, passed, detail)."""
    rows = [F.struct(F.lit(k).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), d.cast("double").alias("detail")) for k, (ok, d) in checks.items()]
    return one.select(F.inline(F.array(*rows)))


def paired_checks(df: DataFrame, site: str, t: str, lab: str, gap: str, target: str, features: list[str], expect_sites: int | None, max_gap: float = 900) -> DataFrame:
    """Invariants of a paired table: sites, sign, match gap, unique key, target, features."""
    one = df.agg(
        F.min(lab).alias("lo"), F.max(gap).alias("gap"), F.max(F.abs(F.col(target) - F.log1p(lab))).alias("dev"),
        *[F.count(x).alias(f"f_{x}") for x in features],
    )
    sites = df.groupBy(site).agg(F.count("*").alias("_n")).agg(F.count("*").alias("sites"))
    dup = df.groupBy(site, t).agg(F.count("*").alias("_n")).agg(F.sum(F.col("_n") - 1).alias("dup"))
    one = with_scalar(with_scalar(one, sites), dup)
    empty = sum(((F.col(f"f_{x}") == 0).cast("int") for x in features), F.lit(0))
    return _verdicts(one, {
        "site count": (F.lit(True) if expect_sites is None else F.col("sites") == expect_sites, F.col("sites")),
        "lab value >= 0": (F.col("lo") >= 0, F.col("lo")),
        "match gap": (F.col("gap") <= max_gap, F.col("gap")),
        "unique key": (F.col("dup") == 0, F.col("dup")),
        "target is log1p": (F.col("dev") < 1e-10, F.col("dev")),
        "no empty feature": (empty == 0, empty),
    })


def feature_checks(df: DataFrame, unit: list[str], binary: list[str], numeric: list[str]) -> DataFrame:
    """Range of season terms, binary flags, columns without spread."""
    one = df.agg(
        *[F.max(F.abs(x)).alias(f"u_{x}") for x in unit],
        *[F.count_if(~F.col(x).isin(0.0, 1.0)).alias(f"b_{x}") for x in binary],
        F.lit(0).alias("_z"), *[(F.min(x) < F.max(x)).alias(f"z_{x}") for x in numeric],
    )
    flat = sum(((~F.coalesce(F.col(f"z_{x}"), F.lit(False))).cast("int") for x in numeric), F.lit(0))
    return _verdicts(one, {
        **{f"{x} in [-1, 1]": (F.col(f"u_{x}") <= 1 + 1e-10, F.col(f"u_{x}")) for x in unit},
        **{f"{x} is binary": (F.col(f"b_{x}") == 0, F.col(f"b_{x}")) for x in binary},
        "no constant column": (flat == 0, flat),
    })


def percent_checks(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(x).alias("col"), F.col(x).cast("double").alias("v")) for x in cols])
    g = df.select(F.inline(pairs)).groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return g.withColumn("passed", (F.col("lo") >= -0.01) & (F.col("hi") <= 100.01))


def merge_check(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Row count unchanged by a join and joined columns not empty."""
    b = before.agg(F.count("*").alias("n_before"))
    a = with_scalar(after.agg(F.count("*").alias("n_after"), *[F.count(x).alias(f"nn_{x}") for x in cols]), b)
    ok = reduce(lambda x, y: x & y, [F.col(f"nn_{x}") > 0 for x in cols], F.col("n_before") == F.col("n_after"))
    return a.withColumn("passed", ok)


def leakage(train: DataFrame, split: DataFrame, site: str) -> DataFrame:
    """Held-out entities present in the training rows; passed when there are none."""
    held = split.where(F.col("role") != "training").select(site)
    n = held.join(train.select(site), site, "left_semi").agg(F.countDistinct(site).alias("n_leaked"))
    return n.withColumn("passed", F.col("n_leaked") == 0)


def table_hash(df: DataFrame, digits: int = 8) -> DataFrame:
    """Order-independent fingerprint: rows to text (rounded numbers, explicit NULLs, each with its length), md5
    halves summed. Summing is associative, so partitioning does not matter."""
    def text(name: str, kind: str) -> Column:
        x = F.col(name)
        if kind in ("double", "float"):
            x = F.round(x.cast("double") * F.lit(float(10**digits)), 0).cast("double")
            large = F.isnan(x) | (F.abs(x) >= F.lit(1e18))
            s = F.when(F.isnan(x), F.lit("NaN")).when(large, F.format_string("%.17e", x)).otherwise(F.when(~large, x).cast("long").cast("string"))
        elif kind.startswith("timestamp"):
            s = F.unix_micros(x.cast("timestamp")).cast("string")
        else:
            s = x.cast("string")
        return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("~"))

    cols = sorted(df.dtypes)
    h = F.md5(F.concat_ws("|", *[text(n, k) for n, k in cols]))
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    return df.select(part(1).alias("a"), part(9).alias("b")).agg(F.count("*").alias("n_rows"), F.sum("a").alias("hash_a"), F.sum("b").alias("hash_b"))


def golden_check(new: DataFrame, stored: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Largest difference to a stored result and rows found on one side only."""
    j = new.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")).join(stored.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r")), keys, "full")
    g = j.agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"),
        F.count_if(F.col("_l").isNull()).alias("n_missing"), F.count_if(F.col("_r").isNull()).alias("n_extra"),
    )
    return g.withColumn("passed", (F.col("max_diff") <= tol) & (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per step and input file."""
    parts = []
    for step, df in tables.items():
        f = df.select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count("*").alias("n_rows"))
        parts.append(f.select(F.lit(step).alias("step"), "file", "n_rows", F.lit(len(df.columns)).alias("n_columns")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def censoring(df: DataFrame, by: list[str], nondetect: Column, limit: Column, flag_pct: float = 10.0) -> DataFrame:
    d = df.withColumn("_nd", nondetect).withColumn("_dl", F.when(F.col("_nd"), limit))
    g = d.groupBy(*by).agg(F.count("*").alias("n_samples"), F.count_if("_nd").alias("n_nondetect"))
    g = g.withColumn("pct_censored", F.round(F.col("n_nondetect") / F.col("n_samples") * 100, 1))
    return g.join(medians(d, by, median_limit="_dl"), by, "left").withColumn("high", F.col("pct_censored") > flag_pct)


def discrete_validity(df: DataFrame, site: str, value: str, t: str) -> DataFrame:
    """Counts, range, median and a flag for constant or all-zero records."""
    g = df.groupBy(site).agg(
        F.count("*").alias("n_total"), F.count(value).alias("n_valid"), F.min(t).alias("first"), F.max(t).alias("last"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
    )
    same = F.col("_lo").isNull() | (F.col("_lo") == F.col("_hi"))
    g = g.join(medians(df, [site], median=value), site, "left")
    return g.select(site, "n_total", "n_valid", (F.col("n_total") - F.col("n_valid")).alias("n_missing"), "first", "last", "median", same.alias("suspicious"))


def qualify(spans: DataFrame, lab: DataFrame, site: str, code: str, required: str, min_days: float, min_n: int, train_n: int) -> DataFrame:
    """Sites with the required sensor, enough overlap and samples; flags and sensor list."""
    req = spans.where(F.col(code) == required).select(site, F.col("s_begin"), F.col("s_end"))
    from freshet.operators.joins import overlap

    d = overlap(req.withColumnsRenamed({"s_begin": "sen_begin", "s_end": "sen_end"}), lab, site, "sen", "lab", min_days)
    d = d.where(F.col("lab_n") >= min_n)
    # one entry per parameter of a site: the list of parameters is short and fixed
    have = spans.groupBy(site).agg(F.array_join(F.array_sort(F.collect_set(code)), ",").alias("params"))
    return d.join(have, site).select(site, "overlap_days", F.col("lab_n").alias("n_samples"), (F.col("lab_n") >= train_n).alias("trainable"), "params")


def param_matrix(df: DataFrame, site: str, code: str, codes: list[str], min_n: int) -> DataFrame:
    g = df.groupBy(site).agg(*[F.count_if(F.col(code) == c).alias(c) for c in codes])
    return g.withColumns({"all_viable": F.least(*codes) >= min_n, "any_viable": F.greatest(*codes) >= min_n})


def gate(counts: DataFrame, site: str, n: str, min_n: int, thresholds: list[int]) -> DataFrame:
    """How many sites have at least k parameters with enough pairable samples."""
    per = counts.groupBy(site).agg(F.count_if(F.col(n) >= min_n).alias("_k"))
    one = per.agg(*[F.count_if(F.col("_k") >= t).alias(f"k{t}") for t in thresholds])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("min_params"), F.col(f"k{t}").alias("n_sites")) for t in thresholds])))


def gap_yield(samples: DataFrame, span: DataFrame, site: str, t: str, prefix: str, rate: float) -> DataFrame:
    """Samples outside the sensor record, the years to fetch on each side, pairs to expect."""
    lo, hi = F.col(f"{prefix}_begin"), F.col(f"{prefix}_end")
    j = spread_join(samples, span, [site], "left")
    before, after = lo.isNull() | (F.col(t) < lo), F.coalesce(F.col(t) > hi, F.lit(False))
    g = j.groupBy(site, lo, hi).agg(
        F.count("*").alias("n_samples"), F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"),
        F.min(F.when(before, F.col(t))).alias("_first"), F.max(F.when(after, F.col(t))).alias("_last"), F.max(t).alias("_max"),
    )
    y0 = F.when(F.col("n_before") > 0, F.greatest(F.year(F.coalesce(lo, F.col("_max"))) - F.year("_first"), F.lit(0))).otherwise(0)
    y1 = F.when(F.col("n_after") > 0, F.greatest(F.year("_last") - F.year(hi), F.lit(0))).otherwise(0)
    out = F.col("n_before") + F.col("n_after")
    edges, labels = [0, 1, 5, 10, 20, 50, 100, 500], ["0", "1-4", "5-9", "10-19", "20-49", "50-99", "100-499", "500+"]
    from freshet.functions.transforms import bin_left

    return g.select(site, "n_samples", "n_before", "n_after", (F.col("n_samples") - out).alias("n_inside"), (y0 + y1).alias("site_years"),
                    F.floor(out * F.lit(rate)).alias("expected"), bin_left(out, edges, labels).alias("outside_bin"))


def param_counts(df: DataFrame, param: str, site: str, value: str) -> DataFrame:
    per = df.groupBy(param, site).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    g = per.groupBy(param).agg(
        F.sum("_n").alias("n_samples"), F.count("*").alias("n_sites"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"),
        F.count_if(F.col("_n") >= 5).alias("sites_5"), F.count_if(F.col("_n") >= 10).alias("sites_10"),
    )
    return g.join(medians(per, [param], median_per_site="_n"), param)


def discover(lab: DataFrame, meta: DataFrame, site: str, order: str, min_n: int) -> DataFrame:
    """Sites with enough samples, with their first metadata row."""
    from freshet.operators.blocks import keep_first

    n = lab.groupBy(site).agg(F.count("*").alias("n_samples")).where(F.col("n_samples") >= min_n)
    return n.join(keep_first(meta, [site], [order]), site)
