"""Joins beyond time matching: attributes, splits, intervals, geography."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.basics import clip, micros, settle, spread_join
from freshet.functions.normalize import region_code
from freshet.operators.blocks import keep_first, medians


def attach(df: DataFrame, attrs: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join attributes, leaving out columns the left side already has."""
    fresh = [x for x in attrs.columns if x == key or x not in df.columns]
    return df.join(attrs.select(*fresh), key, how)


def attach_missing(df: DataFrame, tables: list[tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """For each (table, keys, wanted): add only the wanted columns that are absent."""
    for table, keys, wanted in tables:
        need = [x for x in wanted if x in table.columns and x not in df.columns]
        if need:
            # one row per key, so the join cannot multiply rows
            df = df.join(keep_first(table.select(*keys, *need), keys, need), keys, "left")
    return df


def chain_outer(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer joins left to right; a column seen before is not taken again."""
    return reduce(lambda a, b: attach(a, b, key, "full"), frames)


def feature_tiers(df: DataFrame, basic: DataFrame, shed: DataFrame, site: str = "site") -> dict[str, DataFrame]:
    """A: sensor only; B: plus basic attributes; C: plus watershed, sites that have it."""
    def derive(d: DataFrame) -> DataFrame:
        if "drainage_area_km2" in d.columns:
            d = d.withColumn("log_drainage_area", F.log1p(clip("drainage_area_km2", 0)))
        if "huc2" in d.columns:
            d = d.withColumn("huc2", region_code("huc2"))
        return d

    names = [x for x in ["drainage_area_km2", "huc2", "latitude", "longitude"] if x in basic.columns]
    b = df.join(basic.select(site, *names), site, "left")
    c = df.join(shed.select(site), site, "left_semi")
    c = c.join(basic.select(site, *[x for x in names if x not in shed.columns]), site, "left").join(shed, site, "left")
    return {"A": df, "B": derive(b), "C": derive(c)}


def by_role(df: DataFrame, split: DataFrame, site: str, role: str = "training") -> DataFrame:
    """Training keeps sites without any other role; other roles select their own sites."""
    if role == "training":
        return df.join(split.where(F.col("role") != "training").select(site), site, "left_anti")
    return df.join(split.where(F.col("role") == role).select(site), site, "left_semi")


def same_day(a: DataFrame, b: DataFrame, keys: list[str], order: str, value: str, other: str) -> DataFrame:
    """Pairs on (site, day): first value of one side, median of the other."""
    first = a.where(F.col(value) > 0).groupBy(*keys).agg(F.min_by(value, order).alias(value))
    med = medians(b.where(F.col(other) > 0), keys, **{other: other})
    return first.join(med, keys)


def record_span(df: DataFrame, keys: list[str], t: str, prefix: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(t).alias(f"{prefix}_begin"), F.max(t).alias(f"{prefix}_end"), F.count("*").alias(f"{prefix}_n"))


def overlap(a: DataFrame, b: DataFrame, site: str, pa: str, pb: str, min_days: float) -> DataFrame:
    """Shared span of two records per site, kept when long enough."""
    j = a.join(b, site)
    lo, hi = F.greatest(f"{pa}_begin", f"{pb}_begin"), F.least(f"{pa}_end", f"{pb}_end")
    days = F.floor((micros(hi) - micros(lo)) / F.lit(86_400_000_000))
    return j.withColumns({"overlap_begin": lo, "overlap_end": hi, "overlap_days": days}).where(F.col("overlap_days") >= min_days)


def counts_in_record(samples: DataFrame, span: DataFrame, site: str, t: str, prefix: str) -> DataFrame:
    """Samples before, inside and after the sensor record; all are before if there is none."""
    j = spread_join(samples, span, [site], "left")
    before = F.col(f"{prefix}_begin").isNull() | (F.col(t) < F.col(f"{prefix}_begin"))
    after = F.coalesce(F.col(t) > F.col(f"{prefix}_end"), F.lit(False))
    return j.groupBy(site).agg(
        F.count("*").alias("n_samples"), F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"),
        F.count_if(~before & ~after).alias("n_inside"),
    )


def event_days(events: DataFrame, keys: list[str], start: str, end: str, day: str) -> DataFrame:
    """One row per calendar day an event touches."""
    return events.select(*keys, F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias(day))


#: Points that a cell should hold at most where the search for the nearest one begins, and how often cells are halved for that.
CELL_POINTS = 64
HALVINGS = 24


def _cells(lat: str, lon: str, width: float) -> list[Column]:
    return [F.floor(F.col(lat) / F.lit(width)).alias("_y"), F.floor(F.col(lon) / F.lit(width)).alias("_x")]


def nearest_geo(a: DataFrame, b: DataFrame, a_id: str, b_id: str, max_deg: float = 0.5) -> DataFrame:
    """Nearest b within max_deg (degree distance), the smallest id on ties.

    Both sides go to grid cells; each a visits its nine cells, which hold every point nearer than a cell is wide. The cells are
    so narrow at first that few points share one; an a that finds none that near goes on to cells twice as wide, up to the
    limit. An a thus meets a few points, however many there are within the limit.
    """
    # sites at one coordinate are one point, so a crowded cell stays small
    pts = settle(b.where("lat is not null and lon is not null").groupBy(F.col("lat").alias("_lb"), F.col("lon").alias("_ob")).agg(F.min(b_id).alias(b_id)))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    d2 = (F.col("_lb") - F.col("_la")) * (F.col("_lb") - F.col("_la")) + (F.col("_ob") - F.col("_lo")) * (F.col("_ob") - F.col("_lo"))
    halved = 0
    while halved < HALVINGS:
        fullest = pts.groupBy(*_cells("_lb", "_ob", max_deg / 2**halved)).count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= CELL_POINTS:
            break
        halved += 1
    open_, found = a.select(a_id, F.col("lat").alias("_la"), F.col("lon").alias("_lo")), []
    for k in range(halved, -1, -1):
        width = max_deg / 2**k
        left = open_.select("*", *_cells("_la", "_lo", width)).withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
        left = left.withColumn("_y", F.col("_y") + F.col("_dy")).withColumn("_x", F.col("_x") + F.col("_dx")).drop("_dy", "_dx")
        # a hair less than the width, as the cell numbers are rounded; the limit itself holds as it is
        near = F.col("_d") < (width if k == 0 else width * 0.999)
        j = left.join(pts.select("*", *_cells("_lb", "_ob", width)), ["_y", "_x"]).withColumn("_d", F.sqrt(d2)).where(near)
        m = j.groupBy(a_id).agg(F.min(F.struct(F.col("_d").alias("d"), F.col(b_id).alias("b"))).alias("_m"))
        if k:
            m = settle(m)
            open_ = settle(open_.join(m.select(a_id), a_id, "left_anti"))
        found.append(m)
    m = reduce(lambda x, y: x.union(y), found).groupBy(a_id).agg(F.min("_m").alias("_m"))
    return m.select(a_id, F.col("_m.b").alias(b_id), F.col("_m.d").alias("distance"))


def inside(x: str | Column, y: str | Column, ring: str) -> Column:
    """Even-odd ray test of a point against a closed ring array<struct<x,y>>."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    rg = F.col(ring)
    nxt = F.concat(F.slice(rg, 2, F.size(rg)), F.slice(rg, 1, 1))
    crosses = F.zip_with(
        rg, nxt,
        lambda a, b: F.when(
            ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1
        ).otherwise(0),
    )
    return F.aggregate(crosses, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def point_in_polygon(points: DataFrame, polys: DataFrame, pid: str, gid: str, cell: float = 1.0) -> DataFrame:
    """Smallest polygon id that holds each point, NULL if none.

    Polygons are copied to the grid cells of their bounding box, points to one cell.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell))
    g = polys.withColumn("_cx", F.explode(span(xs))).withColumn("_cy", F.explode(span(ys)))
    p = points.withColumn("_cx", F.floor(F.col("lon") / cell)).withColumn("_cy", F.floor(F.col("lat") / cell))
    hit = p.join(g, ["_cx", "_cy"]).where(inside("lon", "lat", "ring")).groupBy(pid).agg(F.min(gid).alias(gid))
    return points.join(hit, pid, "left")


def new_or_more(found: DataFrame, known: DataFrame, site: str, count: str) -> DataFrame:
    """Sites not known yet, or with more extreme rows than known."""
    j = found.join(known.select(site, F.col(count).alias("_old")), site, "left")
    return j.withColumn(
        "status", F.when(F.col("_old").isNull(), "new").when(F.col(count) > F.col("_old"), "more").otherwise("same")
    ).drop("_old")


