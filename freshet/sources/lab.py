"""Laboratory tables in the export dialects found in the wild, to one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

# fixed values: export column -> internal column, both dialects
DIALECT = {
    "Activity_StartDate": "sample_date", "ActivityStartDate": "sample_date",
    "Activity_StartTime": "sample_clock", "ActivityStartTime/Time": "sample_clock",
    "Activity_StartTimeZone": "zone", "ActivityStartTime/TimeZoneCode": "zone",
    "Result_Measure": "measure", "ResultMeasureValue": "measure",
    "Result_ResultDetectionCondition": "condition", "ResultDetectionConditionText": "condition",
    "DetectionQuantitationLimitMeasure_MeasureValue": "limit", "DetectionQuantitationLimitMeasure/MeasureValue": "limit",
}


def unify_dialects(frames: list[DataFrame]) -> DataFrame:
    parts = [d.withColumnsRenamed({k: v for k, v in DIALECT.items() if k in d.columns}) for d in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = [x for x in cols if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns[:10]}")
    return df


def parse_lab(
    raw: DataFrame, site: str, limits: list[str], default: float, drop_contaminated: bool = False
) -> DataFrame:
    """Raw lab strings to (site, time, value, is_nondetect, method, pos), one row per time.

    Rows without a usable clock time or zone are dropped, never guessed.
    """
    from freshet.functions import normalize as N
    from freshet.operators import dedup, qc

    d = raw.where(~N.contaminated("condition")) if drop_contaminated else raw
    d = d.withColumn("time", N.to_utc("start_date", "start_time", "start_tz")).where("time is not null")
    d = d.withColumn("value", N.number("measure")).withColumn("method", N.collection_method("equipment"))
    d = qc.substitute_nondetects(d, site, "value", limits, "condition", default)
    d = d.where("value >= 0").select(site, "time", "value", "is_nondetect", "method", "org", "pos")
    return dedup.resolve_conflicts(d, [site, "time"], "value", "org", "pos").drop("org", "n_copies", "was_conflict")
