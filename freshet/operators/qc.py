"""Quality filters on sensor and lab rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions import normalize as N
from freshet.functions.basics import micros, spread_join
from freshet.operators.blocks import medians, modal, ordered, quantiles

# fixed values: hours dropped after the end of a flagged episode
BUFFER_HOURS = {"ICE": 48, "MAINT": 4}
EPISODE_GAP_S = 3600


def approved(df: DataFrame, col: str = "approval_status", provisional: bool = False) -> DataFrame:
    ok = ["Approved", "Provisional"] if provisional else ["Approved"]
    d = df.withColumn(col, N.approval(col))
    return d.where(F.coalesce(F.col(col).isin(ok), F.lit(False)))


def bad_qualifier(col: str = "qualifier") -> Column:
    codes = F.array(*[F.lit(x) for x in N.EXCLUDE_CODES])
    return F.arrays_overlap(N.qualifier_codes(col), codes)


def episode_ends(df: DataFrame, by: list[str], t: str, uid: str, qualifier: str, hours: dict[str, float], gap_s: float) -> DataFrame:
    """(by, end, until) of every flagged episode: its last row has no flagged row of the
    same code within the gap after it. Only flagged rows are shuffled."""
    up = F.upper(F.coalesce(F.col(qualifier), F.lit("")))
    codes = F.array(*[
        F.when(up.contains(x), F.struct(F.lit(x).alias("code"), F.lit(int(h * 3_600_000_000)).alias("keep_out")))
        for x, h in hours.items()
    ])
    flagged = df.select(*by, uid, micros(t).alias("_t"), F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("_f"))
    flagged = flagged.select(*by, uid, "_t", F.col("_f.code").alias("_code"), F.col("_f.keep_out").alias("_w"))
    nxt = ordered(flagged, [*by, "_code"], ["_t", uid], F.floor(F.col("_t") / F.lit(30 * 86_400_000_000)), follow={"_n": F.col("_t")})
    return nxt.where(F.col("_n").isNull() | (F.col("_n") - F.col("_t") > int(gap_s * 1e6))).select(
        *by, F.col("_t").alias("end"), (F.col("_t") + F.col("_w")).alias("until")
    )


def flag_buffer(
    df: DataFrame,
    by: list[str],
    t: str,
    uid: str,
    qualifier: str = "qualifier",
    hours: dict[str, float] | None = None,
    gap_s: float = EPISODE_GAP_S,
    out: str = "in_buffer",
) -> DataFrame:
    """Mark rows in (end, end + buffer] of any flagged episode.

    ``df`` holds every approved row, flagged ones included. Buffers are listed per time
    slice as wide as the longest buffer; episodes are at least a gap apart, so a list
    is short. Each reading then meets one list: a left equi-join, no window over the
    whole series.
    """
    hours = hours or BUFFER_HOURS
    width = F.lit(int(max(hours.values()) * 3_600_000_000))
    ends = episode_ends(df, by, t, uid, qualifier, hours, gap_s).distinct()
    lists = (
        ends.withColumn("_slice", F.explode(F.sequence(F.floor(F.col("end") / width), F.floor(F.col("until") / width))))
        .groupBy(*by, "_slice").agg(F.collect_list(F.struct("end", "until")).alias("_buf"))
    )
    d = df.withColumn("_t", micros(t)).withColumn("_slice", F.floor(F.col("_t") / width))
    hit = F.exists("_buf", lambda x: (F.col("_t") > x["end"]) & (F.col("_t") <= x["until"]))
    return d.join(lists, [*by, "_slice"], "left").select(*df.columns, F.coalesce(hit, F.lit(False)).alias(out))


def in_range(col: str = "value", lo: float = -0.01, hi: float = 100_000.0) -> Column:
    return F.coalesce(F.col(col).between(lo, hi), F.lit(False))


def qc_marked(
    df: DataFrame, by: list[str], t: str, uid: str, provisional: bool = False,
    hours: dict[str, float] | None = None,
) -> DataFrame:
    """Every row with its stage: not_approved, bad_qualifier, buffer, range or kept."""
    ok = approved(df, provisional=provisional)
    buf = flag_buffer(ok, by, t, uid, hours=hours)
    stage = (
        F.when(bad_qualifier(), "bad_qualifier")
        .when(F.col("in_buffer"), "buffer")
        .when(~in_range(), "range")
        .otherwise("kept")
    )
    return buf.withColumn("stage", stage).drop("in_buffer")


def clean_series(df: DataFrame, by: list[str], t: str, uid: str, **kw) -> DataFrame:
    return qc_marked(df, by, t, uid, **kw).where("stage = 'kept'").drop("stage")


def qc_stats(df: DataFrame, site: str, by: list[str], t: str, uid: str, **kw) -> DataFrame:
    marked = qc_marked(df, by, t, uid, **kw).groupBy(site).agg(
        F.count("*").alias("_ok"),
        *[F.count_if(F.col("stage") == s).alias(n) for s, n in [
            ("bad_qualifier", "n_bad_qualifier"), ("buffer", "n_buffer_excluded"), ("range", "n_range_excluded"),
            ("kept", "n_after_filter")]],
    )
    n = df.groupBy(site).agg(F.count("*").alias("n_original"))
    z = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return n.join(marked, site, "left").select(
        site, "n_original", (F.col("n_original") - F.coalesce("_ok", F.lit(0))).alias("n_not_approved"),
        z("n_bad_qualifier"), z("n_buffer_excluded"), z("n_range_excluded"), z("n_after_filter"),
        F.round(F.coalesce("n_after_filter", F.lit(0)) / F.col("n_original") * 100, 1).alias("pct_retained"),
    )


def high_censoring(df: DataFrame, site: str = "site", flag: str = "is_nondetect", share: float = 0.5) -> DataFrame:
    """Sites whose non-detect share exceeds the threshold."""
    return df.groupBy(site).agg(F.avg(F.col(flag).cast("double")).alias("_s")).where(F.col("_s") > share).select(site)


def drop_sites(df: DataFrame, bad: DataFrame, site: str = "site") -> DataFrame:
    return df.join(bad.select(site).distinct(), site, "left_anti")


def min_samples(df: DataFrame, site: str, n: int) -> DataFrame:
    keep = df.groupBy(site).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(site)
    return df.join(keep, site, "left_semi")


def substitute_nondetects(
    df: DataFrame, site: str, value: str, limits: list[str], condition: str, default: float
) -> DataFrame:
    """Non-detect result to half its limit.

    Per site the first limit column with any usable value among non-detects is taken;
    a missing limit falls back to the result, a limit of zero or less to the default.
    """
    nd = F.coalesce(F.lower(F.col(condition)).contains("not detect"), F.lit(False))
    d = df.withColumn("is_nondetect", nd)
    has = d.groupBy(site).agg(
        *[F.max((F.col("is_nondetect") & N.number(x).isNotNull()).cast("int")).alias(f"_h{i}") for i, x in enumerate(limits)]
    )
    d = spread_join(d, has, [site])
    pick = F.lit(None).cast("double")
    for i, x in reversed(list(enumerate(limits))):
        pick = F.when(F.col(f"_h{i}") == 1, N.number(x)).otherwise(pick)
    dl = F.coalesce(pick, F.col(value))
    dl = F.when(dl > 0, dl).otherwise(F.lit(float(default)))
    return d.withColumn(value, F.when(F.col("is_nondetect"), dl / 2).otherwise(F.col(value))).drop(
        *[f"_h{i}" for i in range(len(limits))]
    )


def site_profile(df: DataFrame, site: str, value: str, method: str, source_ok: Column) -> DataFrame:
    """Per-site count, median, sample std, modal method and share from the main source."""
    a = df.groupBy(site).agg(
        F.count(value).alias("n_samples"), F.stddev_samp(value).alias("std"), F.avg(source_ok.cast("double")).alias("src_share")
    )
    return a.join(medians(df, [site], median=value), site).join(modal(df, [site], method, "method_mode"), site)


def quality_tiers(profile: DataFrame, known: list[str]) -> DataFrame:
    k = F.col("method_mode").isin(known)
    n = F.col("n_samples")
    return profile.select(
        "*",
        ((n >= 50) & k & (F.col("std") > 100)).alias("d1"),
        ((n >= 20) & k).alias("d2"),
        (n >= 10).alias("d3"),
        F.lit(True).alias("d4"),
        (F.col("src_share") == 1.0).alias("d5"),
    )


def low_variance_sites(df: DataFrame, site: str, value: str) -> DataFrame:
    """Sites below the upper end of the lowest quartile of per-site std."""
    from freshet.functions.basics import with_scalar

    std = df.groupBy(site).agg(F.stddev_samp(value).alias("std"))
    edge = quantiles(std, [], {"_q": ("std", 0.25)})
    top = with_scalar(std, edge).where(F.col("std") <= F.col("_q")).agg(F.max("std").alias("_b3"))
    return with_scalar(std, top).where(F.col("std") < F.col("_b3")).select(site)
