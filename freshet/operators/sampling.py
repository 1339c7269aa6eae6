"""Splits and resampling. Draws hash stable keys, so they survive retries and reordering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.basics import dealt, draw, micros, settle, value_block, with_scalar
from freshet.functions.draws import draws
from freshet.operators.blocks import by_time, ordered, quantiles


def number_entities(df: DataFrame, key: str, seed: int | str, out: str = "idx", total: str = "n_all", by: list[str] | None = None) -> DataFrame:
    """1..n in md5 order of the key; the 32-bit draw itself gives the slices."""
    d = df.withColumn("_d", draw(F.lit(str(seed)), key))
    return ordered(d, by or [], ["_d", key], F.floor(F.col("_d") / F.lit(1 << 22)), number=out, total=total).drop("_d")


def bootstrap_rows(entities: DataFrame, key: str, seed: int | str, reps: int, counted: bool = False) -> DataFrame:
    """The rows of ``entities`` with ``rep``: every replicate draws as many entities as there are, with repeats.

    Draw d of replicate b picks entity number draw(seed, b, d) mod n. Each entity row
    emits its own draw numbers, so nothing is generated on the driver. Draws travel as two numbers and meet the far smaller table of
    numbered entities by its hash; which side that is is said here, as estimates take the draws for the smaller one. With
    ``counted`` an entity comes once a replicate, with its number of draws ``m``.
    """
    num = settle(number_entities(entities.select(key).distinct(), key, seed))
    rows = num.count() * reps
    slots = dealt(num.select("idx", "n_all"), rows=rows).select("idx", "n_all", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    picks = slots.select("rep", (draw(F.lit(str(seed)), "rep", "idx") % F.col("n_all") + 1).alias("pick"))
    picks = dealt(picks, "pick", rows=rows)
    if counted:
        picks = picks.groupBy("pick", "rep").agg(F.count(F.lit(1)).alias("m"))
    own = num.select(F.col("idx").alias("pick"), key).join(entities, key)
    return picks.join(own.hint("shuffle_hash"), "pick").drop("pick")


#: Entities of one group that a task holds while it draws from them; draws and replicates it holds at once, and entities of one packed row.
HELD = 1 << 22
DRAWN = 1 << 24
REPS = 32
PACKED = 1 << 16


def _weighted_middle(v: np.ndarray, times: np.ndarray) -> float | None:
    """Median of ascending values that come so many times each, as ``quantiles`` interpolates it; None where none comes."""
    upto = np.cumsum(times)
    n = int(upto[-1]) if len(upto) else 0
    if not n:
        return None
    lo, hi = v[np.searchsorted(upto, [(n - 1) // 2, n // 2], "right")]
    return float(lo + (hi - lo) * ((n - 1) / 2 - (n - 1) // 2))


def resampled_medians(num: DataFrame, by: list[str], idx: str, total: str, col: str, seed: int | str, reps: int, most: int, once: bool = False) -> DataFrame:
    """``(*by, rep, _x)``: the median of ``col`` over the entities that each replicate draws.

    ``num`` has the number ``idx`` (1 to ``total``, ``most`` at most) of the entity that a row belongs to. Draw d of replicate b picks number
    draw(seed, b, d) mod total, as often as there are entities; with ``once`` a picked entity counts once. A task has some replicates: it makes
    their draws once for all groups, and groups come to it one after the other as packed columns, so no draw is ever a row.
    """
    some = max(1, min(REPS, DRAWN // max(1, most)))
    chunks = -(-reps // some)
    packs = num.select(*by, F.col(total).cast("long").alias("_m"), F.floor(F.col(idx) / PACKED).alias("_b"), F.col(idx).cast("int").alias("_i"), F.col(col).cast("double").alias("_v"))
    packs = packs.groupBy(*by, "_m", "_b").agg(F.collect_list("_i").alias("_is"), F.collect_list("_v").alias("_vs"))
    packs = packs.withColumn("_g", F.xxhash64(*by, "_m")).select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_c"))
    sent = packs.repartition(4 * chunks, "_c").sortWithinPartitions("_c", *by, "_m", "_b").select("_c", "_g", "_m", *by, "_is", "_vs")
    kinds = {f.name: f.dataType.simpleString() for f in num.schema.fields}
    names = [*by, "rep", "_x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}

        def counts(c: int, m: int) -> np.ndarray:
            """How often each replicate of the chunk draws each entity of a group of this size."""
            if made.get("c") != c:
                keys = [b"%d" % k for k in range(c * some + 1, min((c + 1) * some, reps) + 1)]
                made.update(c=c, m=None, keys=keys, draws=np.ascontiguousarray(draws(str(seed).encode(), keys, [b"%d" % d for d in range(1, most + 1)]).T))
            if made["m"] != m:
                made.update(m=m, counts=[np.bincount(d[:m] % np.uint32(m), minlength=m) for d in made["draws"]])
            return made["counts"]

        def done(c: int, m: int, head: pa.RecordBatch, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            i, v = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(v, kind="stable")
            i, v = i[order] - 1, v[order]
            got = [_weighted_middle(v, (n[i] > 0) if once else n[i]) for n in counts(c, m)]
            here = [k for k, x in enumerate(got) if x is not None]
            zero = pa.array(np.zeros(len(here), np.int64))
            cols = [head.column(k).take(zero) for k in by]
            return pa.RecordBatch.from_arrays([*cols, pa.array([c * some + 1 + k for k in here], pa.int32()), pa.array([got[k] for k in here], pa.float64())], names=names)

        last, head, parts = None, None, []
        for b in batches:
            keys = list(zip(*[b.column(k).to_pylist() for k in ("_c", "_g", "_m")]))
            for r, key in enumerate(keys):
                if key != last and parts:
                    yield done(last[0], last[2], head, parts)
                    parts = []
                if not parts:
                    last, head = key, b.slice(r, 1)
                one = b.slice(r, 1)
                parts.append(tuple(one.column(k).flatten().to_numpy() for k in ("_is", "_vs")))
        if parts:
            yield done(last[0], last[2], head, parts)

    return sent.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "rep int", "_x double"]))


def bootstrap_sums(entities: DataFrame, key: str, seed: int | str, reps: int, aggs: list[Column]) -> DataFrame:
    """One row per replicate: aggregates over the drawn entity rows."""
    return bootstrap_rows(entities, key, seed, reps).groupBy("rep").agg(*aggs)


def interval(reps: DataFrame, cols: list[str], lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval over replicates; their number is a parameter, so it is bounded."""
    aggs = []
    for x in cols:
        aggs += [F.percentile(x, F.lit(lo)).alias(f"{x}_lo"), F.percentile(x, F.lit(hi)).alias(f"{x}_hi")]
    return reps.agg(*aggs)


def bootstrap_median(values: DataFrame, key: str, value: str, seed: int | str, reps: int) -> DataFrame:
    """Median with a 95 % interval from entity resampling."""
    v = values.where(F.col(value).isNotNull()).select(key, value)
    v = settle(v)
    per = quantiles(bootstrap_rows(v, key, seed, reps), ["rep"], {"median": (value, 0.5)}, few=True)
    return with_scalar(interval(per, ["median"]), quantiles(v, [], {"median": (value, 0.5)}))


def temporal_split(df: DataFrame, site: str, t: str, uid: str, share: float = 0.7, slice_s: float = 90 * 86_400) -> DataFrame:
    """First share of each site's rows in time order is training."""
    d = ordered(df.withColumn("_t", micros(t)), [site], ["_t", uid], by_time(t, slice_s), number="rn", total="n_site")
    return d.withColumn("is_train", F.col("rn") <= F.floor(F.col("n_site") * F.lit(share))).drop("_t")


def group_shuffle(df: DataFrame, site: str, seed: int | str, share: float = 0.85) -> DataFrame:
    """Whole sites to training until the share is reached, in md5 order."""
    num = number_entities(df.select(site).distinct(), site, seed)
    lab = num.select(site, (F.col("idx") <= F.floor(F.col("n_all") * F.lit(share))).alias("is_train"))
    return df.join(lab, site)


def balanced_folds(df: DataFrame, site: str, target: str, folds: int = 5) -> DataFrame:
    """Sites by falling median target, dealt round-robin into folds."""
    med = quantiles(df, [site], {"med": (target, 0.5)}).withColumn("_neg", -F.col("med"))
    num = ordered(med, [], ["_neg", site], value_block("_neg"), number="_rn")
    return num.select(site, "med", F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int").alias("fold"))


def stratified_holdout(sites: DataFrame, site: str, stratum: str, n: str, seed: int | str, share: float = 0.2, min_hold: int = 2, min_n: int = 20) -> DataFrame:
    """Role per site: sites with few samples are held out; of the rest a share per stratum
    (at least ``min_hold``, leaving one for training)."""
    d = sites.withColumn("_big", F.col(n) >= min_n)
    num = number_entities(d.where("_big"), site, seed, out="_rn", total="_m", by=[stratum])
    target = F.least(F.greatest(F.floor(F.col("_m") * F.lit(share)), F.lit(min_hold)), F.col("_m") - 1)
    big = num.withColumn("role", F.when(F.col("_rn") <= target, "holdout").otherwise("training")).drop("_rn", "_m")
    return big.unionByName(d.where("not _big").withColumn("role", F.lit("holdout"))).drop("_big")


def extreme_split(sites: DataFrame, site: str, state: str, n: str, extreme: str, share: float = 0.25) -> DataFrame:
    """Vault: the two sites with most extreme rows (one if only one has two or more).
    Holdout: the largest remaining site of each state, states in order, up to a share."""
    cand = sites.where(F.col(extreme) >= 2).orderBy(F.desc(extreme), site).limit(2).select(site, F.lit("vault").alias("_v"))
    d = sites.join(cand, site, "left")
    rest = d.where("_v is null")
    best = rest.groupBy(state).agg(F.min(F.struct((-F.col(n)).alias("n"), F.col(site).alias("s")))["s"].alias(site))
    goal = rest.agg(F.greatest(F.lit(1), F.round(F.count("*") * F.lit(share))).alias("_goal"))
    # one row per state: the list of states is a fixed dimension
    w = W.partitionBy(F.lit(0)).orderBy(state)
    held = with_scalar(best.withColumn("_rn", F.row_number().over(w)), goal).where(F.col("_rn") <= F.col("_goal"))
    out = d.join(held.select(site, F.lit("holdout").alias("_h")), site, "left")
    return out.withColumn("role", F.coalesce("_v", "_h", F.lit("training"))).drop("_v", "_h")


def random_subsets(sites: DataFrame, site: str, seeds: list[int], k: int) -> DataFrame:
    """k sites per seed in md5 order; the per-seed limit is applied before the shuffle."""
    d = sites.select(site).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    w = W.partitionBy("seed").orderBy(draw("seed", site), site)
    return d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def proportional_subsets(sites: DataFrame, site: str, stratum: str, seeds: list[int], k: int) -> DataFrame:
    """Per seed: each stratum gives its share of k (at least one), trimmed to k in md5 order."""
    d = sites.select(site, stratum).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    num = number_in(d, ["seed", stratum], ["seed", site], site)
    total = sites.agg(F.count("*").alias("_all"))
    take = F.least(F.greatest(F.lit(1), F.round(F.col("_m") * F.lit(float(k)) / F.col("_all"))), F.col("_m"))
    picked = with_scalar(num, total).where(F.col("_rn") <= take).select("seed", site, stratum)
    w = W.partitionBy("seed").orderBy(draw(F.lit("trim"), "seed", site), site)
    return picked.withColumn("_t", F.row_number().over(w)).where(F.col("_t") <= k).drop("_t")


def number_in(df: DataFrame, by: list[str], keys: list, uid: str) -> DataFrame:
    """Number rows per group in md5 order of the keys: ``_rn`` of ``_m``."""
    d = df.withColumn("_d", draw(*keys))
    return ordered(d, by, ["_d", uid], F.floor(F.col("_d") / F.lit(1 << 22)), number="_rn", total="_m").drop("_d")


def stratified_sites(profile: DataFrame, site: str, spread: str, level: str, method: str, k: int, seed: int) -> DataFrame:
    """Sites sampled per (spread tercile, level tercile, method) in proportion to the stratum."""
    from freshet.functions.transforms import quantile_bins

    d = quantile_bins(quantile_bins(profile, spread, ["low", "mid", "high"], "_sb"), level, ["low", "mid", "high"], "_lb")
    d = d.withColumn("stratum", F.concat_ws("/", "_sb", "_lb", method)).select(site, "stratum")
    num = number_in(d, ["stratum"], [F.lit(str(seed)), site], site)
    total = profile.agg(F.count("*").alias("_all"))
    take = F.least(F.greatest(F.lit(1), F.round(F.col("_m") * F.lit(float(k)) / F.col("_all"))), F.col("_m"))
    picked = with_scalar(num, total).where(F.col("_rn") <= take).select(site, "stratum")
    return picked.orderBy(draw(F.lit(str(seed)), F.lit("trim"), site), site).limit(k)


def covering_sites(df: DataFrame, site: str, cats: list[str], k: int) -> DataFrame:
    """First site (in order) of every categorical value, then the first others up to k."""
    pairs = F.array(*[F.struct(F.lit(x).alias("col"), F.col(x).cast("string").alias("val")) for x in cats])
    firsts = df.select(site, F.inline(pairs)).where("val is not null").groupBy("col", "val").agg(F.min(site).alias(site))
    must = firsts.select(site).distinct().withColumn("why", F.lit(0))
    every = df.select(site).distinct().withColumn("why", F.lit(1))
    # the values to cover may outnumber k; padding only fills what is left of k
    ranked = must.unionByName(every).groupBy(site).agg(F.min("why").alias("why"))
    n_must = must.agg(F.count("*").alias("_n"))
    pad = ranked.where("why = 1").orderBy(site).limit(k)
    w = W.partitionBy(F.lit(0)).orderBy(site)
    pad = with_scalar(pad.withColumn("_rn", F.row_number().over(w)), n_must).where(F.col("_rn") <= k - F.col("_n"))
    return ranked.where("why = 0").select(site, F.lit("cover").alias("reason")).unionByName(pad.select(site, F.lit("pad").alias("reason")))
