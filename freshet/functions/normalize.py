"""Text and code normalisation as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from freshet.functions.basics import c

# fixed values: hours east of UTC per time-zone abbreviation
TZ_HOURS = {
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10, "AST": -4, "UTC": 0, "GMT": 0,
}
# fixed values: standard-time hours per state
STATE_HOURS = {"MT": -7, "NE": -6, "KS": -6, "MO": -6, "CO": -7, "NM": -7, "UT": -7, "WA": -8, "OR": -8}
STATE_DEFAULT_HOURS = -7
# fixed values: qualifier codes that make a reading unusable, and codes that do not
EXCLUDE_CODES = [
    "ICE", "EQUIP", "EQP", "BACKWATER", "BKW", "MAINT", "MNT", "DISCONTINUED", "UNAVAIL", "DRY", "DEBRIS",
]
# fixed values: text that marks an unreliable laboratory result
CONTAMINATION = [
    "systematic contamination", "contamination", "detected not quantified", "present above quantification limit",
]
# fixed values: default detection limit per parameter
DEFAULT_LIMITS = {
    "ssc": 1.0, "total_phosphorus": 0.01, "nitrate_nitrite": 0.04, "tds_evaporative": 5.0, "orthophosphate": 0.005,
}
# fixed values: sampler text per collection method, in order of precedence
METHOD_WORDS = {
    "auto_point": ["automatic", "peristaltic", "submersible"],
    "depth_integrated": [
        "dh-", "dh ", "d-7", "d-9", "p-6", "us d", "us p", "equal width", "equal discharge", "multiple vertical",
        "bag sampler",
    ],
    "grab": ["grab", "open-mouth", "van dorn", "kemmerer", "weighted-bottle", "weighted bottle"],
}
# fixed values: sensor family per method code
SENSOR_FAMILIES = {"TS213": "exo", "TS087": "ysi_6series", "TS086": "ysi_6026"}
# fixed values: parameter per parameter code and per characteristic name
CODE_PARAMETERS = {
    "80154": "ssc", "00665": "total_phosphorus", "00631": "nitrate_nitrite", "00671": "orthophosphate",
}
NAME_PARAMETERS = {
    "Suspended sediment concentration (SSC)": "ssc",
    "Suspended Sediment Concentration (SSC)": "ssc",
    "Total suspended solids": "ssc",
    "Phosphorus": "total_phosphorus",
    "Inorganic nitrogen (nitrate and nitrite)": "nitrate_nitrite",
    "Nitrate plus nitrite": "nitrate_nitrite",
    "Orthophosphate": "orthophosphate",
}
# fixed values: feature-name prefixes per category, tried in this order after METHOD_FEATURES
METHOD_FEATURES = ["collection_method", "turb_source", "sensor_family", "geol_class", "huc2"]
FEATURE_PREFIXES = {
    "sensor": [
        "turbidity", "conductance", "do_", "ph_", "temp_instant", "discharge", "sensor_offset", "days_since_last",
        "rising_limb", "Q_", "turb_Q", "DO_sat", "SC_turb", "doy_", "log_turb", "turb_sat", "turb_below", "flush_",
    ],
    "weather": ["precip_", "days_since_rain", "temp_at_sample", "temp_mean", "precip_mean"],
    "geology": [
        "pct_", "geo_", "clay_", "sand_", "soil_", "water_table", "compressive", "hydraulic_cond", "sgmc_",
        "rock_nitrogen", "slope_pct",
    ],
}


def lookup(mapping: dict, key: str | Column) -> Column:
    """Value of a small literal map, NULL for unknown keys."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.try_element_at(m, F.coalesce(c(key), F.lit("")))


def approval(raw: str | Column) -> Column:
    """`A`, `P` and compound `A, R` to full words; anything else unchanged."""
    t = F.trim(c(raw))
    first = F.trim(F.split_part(t, F.lit(","), F.lit(1)))
    return F.when(first == "A", "Approved").when(first == "P", "Provisional").otherwise(t)


def batch_approval(cd: str | Column) -> Column:
    """Status from the first letter of a batch code column."""
    first = F.upper(F.substring(F.trim(c(cd)), 1, 1))
    return F.when(first == "A", "Approved").when(first == "P", "Provisional").otherwise("Unknown")


def batch_qualifier(cd: str | Column) -> Column:
    """Everything after the first comma of a batch code column."""
    parts = F.transform(F.split(c(cd), ","), lambda x: F.trim(x))
    rest = F.filter(parts, lambda x, i: (i > 0) & (x != ""))
    return F.nullif(F.array_join(rest, ", "), F.lit(""))


def qualifier_codes(raw: str | Column) -> Column:
    """`['ICE' 'EQUIP']` or `Ice,Eqp` to an upper-case array; missing to an empty one."""
    bare = F.upper(F.regexp_replace(F.coalesce(c(raw), F.lit("")), r"[\[\]'\",\s]+", " "))
    return F.filter(F.split(F.trim(bare), " "), lambda x: (x != "") & (x != "NONE") & (x != "NAN"))


#: A zone at the end of a time.
ZONED = r"[0-9](Z|[+-][0-9]{2}:?[0-9]{2})$"


def iso_layout(text: Column) -> Column:
    """Date and time text as year, month, day with hyphens and the time with colons, told by where its separators stand.

    Known layouts: ``2020-1-2 9:05``, ``2020-01-02T09:05:07.25Z``, ``2020/1/2 9:05``, ``1/2/2020 9:05:07`` (month first),
    ``20200102 0905[07]``. Others come back as they are.
    """
    compact = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})[ T]?([0-9]{2}):?([0-9]{2}):?([0-9]{2})?", "$1-$2-$3 $4:$5:$6")
    slashed = F.regexp_replace(text, "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "$3-$1-$2")
    at = F.instr(text, "/")
    return F.when(F.substring(text, 5, 1) == "-", text).when(at == 5, F.translate(text, "/", "-")).when(at > 0, slashed).otherwise(F.regexp_replace(compact, ":$", ""))


def local_time(date: str, clock: str) -> Column:
    """Date and time text in any known layout, read once; NULL without a time of day, in another layout or off the calendar."""
    joined = F.concat_ws(" ", F.trim(date), F.nullif(F.trim(clock), F.lit("")))
    timed = joined.rlike("^.{6,10}[ T] *[0-9]")
    return F.when(timed, iso_layout(joined).try_cast("timestamp"))


def to_utc(date: str, clock: str, zone: str | Column) -> Column:
    """Local date and time text plus zone abbreviation to UTC, NULL if unusable; a zone inside the text goes before the abbreviation."""
    return shift_hours(local_time(date, clock), F.when(_zoned(date, clock), 0).otherwise(lookup(TZ_HOURS, zone)))


def to_utc_state(date: str, clock: str, state: str) -> Column:
    hours = F.coalesce(lookup(STATE_HOURS, state), F.lit(STATE_DEFAULT_HOURS))
    return shift_hours(local_time(date, clock), F.when(_zoned(date, clock), 0).otherwise(hours))


def _zoned(date: str, clock: str) -> Column:
    return F.coalesce(F.nullif(F.trim(clock), F.lit("")), F.trim(date)).rlike(ZONED)


def shift_hours(local: Column, hours: Column) -> Column:
    us = F.unix_micros(local) - hours.cast("long") * F.lit(3_600_000_000)
    return F.timestamp_micros(us).cast("timestamp_ntz")


def number(raw: str | Column) -> Column:
    return c(raw).try_cast("double")


def site_number(raw: str | Column) -> Column:
    """Agency station id: up to seven digits get one leading zero."""
    s = c(raw).cast("string")
    return F.concat(F.lit("ST-"), F.when(F.length(s) <= 7, F.concat(F.lit("0"), s)).otherwise(s))


def pad8(raw: str | Column) -> Column:
    """Zero-pad to 8; a 9-digit number loses its extra leading zero."""
    s = c(raw).cast("string")
    return (
        F.when(F.length(s) < 8, F.lpad(s, 8, "0"))
        .when((F.length(s) == 9) & s.startswith("0"), F.substring(s, 2, 8))
        .otherwise(s)
    )


def region_code(raw: str | Column) -> Column:
    """`unknown` to NULL, numbers to two digits."""
    n = F.nullif(c(raw).cast("string"), F.lit("unknown")).try_cast("double").cast("int").cast("string")
    return F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)


def collection_method(equipment: str | Column) -> Column:
    e = F.lower(c(equipment))
    out = F.lit("unknown")
    for name, words in reversed(METHOD_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | e.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def sensor_family(code: str | Column) -> Column:
    return F.coalesce(lookup(SENSOR_FAMILIES, F.upper(F.trim(c(code)))), F.lit("unknown"))


def feature_category(name: str | Column) -> Column:
    n = c(name)
    out = F.lit("watershed")
    for cat, prefixes in reversed(FEATURE_PREFIXES.items()):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | n.startswith(p)
        out = F.when(hit, cat).otherwise(out)
    return F.when(n.isin(METHOD_FEATURES), "method").otherwise(out)


def parameter_of(code: str | Column, name: str | Column) -> Column:
    """Parameter by code, else by characteristic name, else the raw code."""
    code = F.trim(c(code))
    return F.coalesce(lookup(CODE_PARAMETERS, code), code, lookup(NAME_PARAMETERS, name))


def contaminated(condition: str | Column) -> Column:
    return F.coalesce(F.lower(c(condition)).rlike("|".join(CONTAMINATION)), F.lit(False))
