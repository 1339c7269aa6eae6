"""Watershed attribute tables: one row per site."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.basics import clip
from freshet.functions.transforms import dominant

# fixed values: raw watershed column -> internal name
GEOLOGY = {
    "pctsilicicws": "pct_siliciclastic", "pctcarbresidws": "pct_carbonate_resid",
    "pctnoncarbresidws": "pct_nonite_resid", "pctalkintruvolws": "pct_alkaline_intrusive",
    "pctextruvolws": "pct_extrusive_volcanic", "pctglactilloamws": "pct_glacial_till_loam",
    "pctglactilclayws": "pct_glacial_till_clay", "pctglactilcrsws": "pct_glacial_till_coarse",
    "pctglaclakecrsws": "pct_glacial_lake_coarse", "pctglaclakefinews": "pct_glacial_lake_fine",
    "pctalluvcoastws": "pct_alluvial_coastal", "pctcoastcrsws": "pct_coastal_coarse",
    "pcteolcrsws": "pct_eolian_coarse", "pcteolfinews": "pct_eolian_fine", "pctsallakews": "pct_saline_lake",
    "pctwaterws": "pct_water_geology", "pctcolluvsedws": "pct_colluvial_sediment", "pcthydricws": "pct_hydric",
}
PLAIN = {
    "wsareasqkm": "drainage_area_km2", "pctwdwet2019ws": "wetland_pct", "pctshrb2019ws": "shrub_pct",
    "pctgrs2019ws": "grass_pct", "caows": "geo_cao", "sio2ws": "geo_sio2", "al2o3ws": "geo_al2o3",
    "fe2o3ws": "geo_fe2o3", "mgows": "geo_mgo", "k2ows": "geo_k2o", "na2ows": "geo_na2o", "clayws": "clay_pct",
    "sandws": "sand_pct", "permws": "soil_permeability", "rckdepws": "soil_rock_depth", "wtdepws": "water_table_depth",
    "omws": "soil_organic_matter", "kffactws": "soil_erodibility", "precip9120ws": "precip_mean_mm",
    "tmean9120ws": "temp_mean_c", "elevws": "elevation_m", "bfiws": "baseflow_index", "runoffws": "runoff_mean",
    "wetindexws": "wetness_index", "damnidstorws": "dam_storage_density", "damdensws": "dam_density",
    "rddensws": "road_density", "popden2010ws": "pop_density", "npdesdensws": "npdes_density",
    "wwtpalldensws": "wwtp_all_density", "wwtpmajordensws": "wwtp_major_density",
    "wwtpminordensws": "wwtp_minor_density", "septicws": "septic_density", "superfunddensws": "superfund_density",
    "coalminedensws": "coalmine_density", "minedensws": "mine_density", "fertws": "fertilizer_rate",
    "manurews": "manure_rate", "nsurpws": "nitrogen_surplus", "pctagdrainagews": "ag_drainage_pct",
    "cbnfws": "bio_n_fixation", "rocknws": "rock_nitrogen", "compstrgthws": "compressive_strength",
    "hydrlcondws": "hydraulic_conductivity", "bankfulldepthws": "bankfull_depth", "bankfullwidthws": "bankfull_width",
    "connws": "hydrologic_connectivity",
}
# fixed values: land cover sums and yearly columns
SUMS = {
    "forest_pct": ["pctdecid2019ws", "pctconif2019ws", "pctmxfst2019ws"],
    "agriculture_pct": ["pctcrop2019ws", "pcthay2019ws"],
    "developed_pct": ["pcturbhi2019ws", "pcturbmd2019ws", "pcturblo2019ws", "pcturbop2019ws"],
}
YEARLY = {
    "pctfrstloss{y}ws": ("forest_loss_{y}", range(2001, 2014)),
    "pcthighsev{y}ws": ("burn_highsev_{y}", range(2000, 2019)),
    "pctimp{y}ws": ("impervious_{y}", (2001, 2004, 2006, 2008, 2011, 2013, 2016, 2019)),
    "n_ags_{y}ws": ("n_ag_{y}", range(2000, 2018)),
    "p_ags_{y}ws": ("p_ag_{y}", range(2000, 2018)),
}
# fixed values: land cover kinds whose 2001 share is kept for changes since then
COVER_2001 = ("pctdecid", "pctconif", "pctmxfst", "pctcrop", "pcthay", "pcturbhi", "pcturbmd", "pcturblo", "pcturbop")
# fixed values: pruned feature -> (raw column, default when the column is absent)
PRUNED = {
    "forest_pct": ("FORESTNLCD06", 0.0), "developed_pct": ("DEVNLCD06", 0.0), "clay_pct": ("CLAYAVE", None),
    "sand_pct": ("SANDAVE", None), "soil_permeability": ("PERMAVE", None), "water_table_depth": ("WTDEPAVE", None),
    "precip_mean_mm": ("PPTAVG_BASIN", None), "temp_mean_c": ("T_AVG_BASIN", None),
    "precip_seasonality": ("PRECIP_SEAS_IND", None), "snow_pct_precip": ("SNOW_PCT_PRECIP", None),
    "elev_mean_m": ("ELEV_MEAN_M_BASIN", None), "slope_pct": ("SLOPE_PCT", None), "baseflow_index": ("BFI_AVE", None),
    "runoff_mean": ("RUNAVE7100", None), "stream_density": ("STREAMS_KM_SQ_KM", None), "n_dams": ("NDAMS_2009", 0.0),
    "dam_storage": ("STOR_NOR_2009", 0.0), "road_density": ("ROADS_KM_SQ_KM", None),
}
# fixed values: pruned text feature -> raw column
PRUNED_TEXT = {"geol_class": "GEOL_HUNT_DOM_CODE", "reference_class": "CLASS", "ecoregion": "AGGECOREGION"}


# fixed values: raw columns of which half must be there
EXPECTED = (
    "FORESTNLCD06", "CROPSNLCD06", "DEVNLCD06", "GEOL_HUNT_DOM_CODE", "CLAYAVE", "SANDAVE", "PERMAVE", "PPTAVG_BASIN",
    "T_AVG_BASIN", "ELEV_MEAN_M_BASIN", "SLOPE_PCT", "BFI_AVE", "CLASS", "AGGECOREGION",
)


def column_or(df: DataFrame, name: str, default: float | None = None, kind: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(default).cast(kind)


def map_attributes(raw: DataFrame, site: str) -> DataFrame:
    """Raw watershed columns (any case) to the internal schema; absent ones are NULL."""
    low = raw.select(*[F.col(x).alias(x.lower()) for x in raw.columns])
    zero = lambda x: F.coalesce(column_or(low, x), F.lit(0.0))
    cols = [F.col(site.lower()).alias(site)]
    cols += [sum((zero(x) for x in parts), F.lit(0.0)).alias(n) for n, parts in SUMS.items()]
    cols += [column_or(low, x).alias(n) for x, n in {**PLAIN, **GEOLOGY}.items()]
    for pat, (name, years) in YEARLY.items():
        cols += [F.col(pat.format(y=y)).alias(name.format(y=y)) for y in years if pat.format(y=y) in low.columns]
    cols += [F.col(f"{x}2001ws").alias(f"{x}_2001") for x in COVER_2001 if f"{x}2001ws" in low.columns]
    out = low.select(*cols)
    return out.withColumn("geol_class", dominant({n: n.removeprefix("pct_") for n in GEOLOGY.values()}))


def prune_attributes(raw: DataFrame, site: str) -> DataFrame:
    """Raw basin columns to the merged feature set; pruned input passes through, a table with few of the raw columns is an error."""
    if "forest_pct" in raw.columns and "FORESTNLCD06" not in raw.columns:
        return raw
    found = [x for x in EXPECTED if x in raw.columns]
    if 2 * len(found) < len(EXPECTED):
        raise ValueError(f"only {len(found)} of {len(EXPECTED)} raw columns: {found}; the table has {raw.columns[:5]}")
    cols = [F.col(site)]
    cols += [column_or(raw, x, d).alias(n) for n, (x, d) in PRUNED.items()]
    cols += [column_or(raw, x, None, "string").alias(n) for n, x in PRUNED_TEXT.items()]
    farm = column_or(raw, "CROPSNLCD06", 0.0) + column_or(raw, "PASTURENLCD06", 0.0)
    cols += [
        farm.alias("agriculture_pct"),
        (column_or(raw, "T_MAX_BASIN") - column_or(raw, "T_MIN_BASIN")).alias("temp_range_c"),
        (column_or(raw, "ELEV_MAX_M_BASIN") - column_or(raw, "ELEV_MIN_M_BASIN")).alias("relief_m"),
    ]
    rest = F.lit(100.0) - F.col("forest_pct") - F.col("agriculture_pct") - F.col("developed_pct")
    return raw.select(*cols).withColumn("other_landcover_pct", clip(rest, 0))


def drop_empty_and_yearly(df: DataFrame, site: str) -> DataFrame:
    """Drop all-NULL columns (one counting pass) and columns named after a year."""
    counts = df.agg(*[F.count(F.col(x)).alias(x) for x in df.columns]).first()
    keep = [x for x in df.columns if x == site or (counts[x] > 0 and not re.search(r"\d{4}", x))]
    return df.select(*keep)


def pivot_classes(df: DataFrame, by: list[str], name: str, value: str, columns: dict[str, str]) -> DataFrame:
    """Class rows to a fixed set of columns, 0 where a class is absent."""
    g = df.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col(name) == raw, F.col(value))), F.lit(0.0)).alias(col) for raw, col in columns.items()]
    )
    return g


def class_percent(df: DataFrame, by: list[str], cls: str, columns: dict[str, str], groups: dict[str, list[str]]) -> DataFrame:
    """Class counts to percentages of all classed rows, plus sums of merged classes."""
    known = F.col(cls).isin(list(columns))
    n = F.count_if(known).cast("double")
    g = df.groupBy(*by).agg(
        *[(F.count_if(F.col(cls) == k) * 100.0 / F.nullif(n, F.lit(0.0))).alias(v) for k, v in columns.items()]
    )
    return g.withColumns({k: sum((F.col(x) for x in v[1:]), F.col(v[0])) for k, v in groups.items()})


def area_percent(df: DataFrame, basins: DataFrame, site: str, cls: str, area: str, basin: str, columns: dict[str, str]) -> DataFrame:
    """Area share per class; the denominator is the basin area or, if larger, the sum."""
    g = df.groupBy(site).agg(
        F.sum(area).alias("_tot"),
        *[F.coalesce(F.sum(F.when(F.col(cls) == k, F.col(area))), F.lit(0.0)).alias(v) for k, v in columns.items()],
    )
    d = g.join(basins, site)
    return d.select(site, *[(F.col(v) / F.greatest(basin, "_tot") * 100).alias(v) for v in columns.values()])
