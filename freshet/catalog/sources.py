"""Readers, writers and incremental ingestion, on files Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from freshet.catalog.registry import query
from freshet.functions import normalize as N
from freshet.functions.basics import scratch
from freshet.sources import files as S
from freshet.streaming import incremental as I

COLS = ["site", "pcode", "time", "value", "approval_status", "qualifier"]


@query("src_chunks", """select site, pcode, time, case when k < 40 then value + 1000 else value end as value from v_obs""")
def _(t):
    # chunk 2023 repeats part of chunk 2024 with other values; the earlier chunk wins
    path = scratch(t.spark, "chunks")
    a = t.obs.where("k < 40").withColumn("value", F.col("value") + 1000).select(*COLS, F.lit("2023_2024").alias("chunk"))
    a.unionByName(t.obs.select(*COLS, F.lit("2024_2025").alias("chunk"))).write.partitionBy("chunk").parquet(path)
    return S.read_chunks(t.spark, path).select("site", "pcode", "time", "value")


@query("src_discrete", """select pos, start_date, measure, 'n' || cast(site % 7 as varchar) as station, coalesce(param_code, 'none') as param from v_labraw""")
def _(t):
    path = scratch(t.spark, "lab")
    d = t.labraw.select("pos", "start_date", "measure", F.concat(F.lit("lab_n"), (F.col("site") % 7).cast("string"), F.lit("_"), F.coalesce("param_code", F.lit("none"))).alias("lab"))
    d.write.partitionBy("lab").parquet(path)
    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("start_date", T.StringType()), T.StructField("measure", T.StringType())])
    return S.read_lab_tree(t.spark, path, schema, r"lab_(n\d+)_(\w+?)/", ["station", "param"])


@query("src_csv", "select c_custkey as custkey, 'Río ' || c_name as name, c_acctbal as acctbal, lpad(cast(c_custkey as varchar), 8, '0') as station from customer where c_mktsegment <> 'BUILDING'")
def _(t):
    path = scratch(t.spark, "csv")
    d = t.table("customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("station"), F.col("c_custkey").alias("custkey"),
                                   F.concat(F.lit("Río "), "c_name").alias("name"), F.col("c_acctbal").alias("acctbal"),
                                   F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    d.write.csv(path, sep="\t", header=True, encoding="ISO-8859-1")
    schema = T.StructType([T.StructField("station", T.StringType()), T.StructField("custkey", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("acctbal", T.DoubleType()), T.StructField("segment", T.StringType())])
    return S.read_delimited(t.spark, path, schema, sep="\t", required=["segment"]).drop("segment")


@query("src_rdb", "select 'AG' as agency_cd, cast(p_partkey as varchar) as site_no, p_type as parm_cd, case when p_partkey % 3 = 0 then null else cast(p_size as varchar) end as result_va from part")
def _(t):
    path = scratch(t.spark, "rdb")
    cols = ["agency_cd", "site_no", "parm_cd", "result_va"]
    short = F.concat_ws("\t", F.lit("AG"), F.col("p_partkey").cast("string"), "p_type")
    line = F.when(F.col("p_partkey") % 3 == 0, short).otherwise(F.concat_ws("\t", short, F.col("p_size").cast("string")))
    head = t.spark.createDataFrame([("# file created",), ("#",), ("\t".join(cols),), ("5s\t15s\t5s\t12n",)], "value string")
    head.unionByName(t.table("part").select(line.alias("value"))).write.text(path)
    return S.read_rdb(t.spark, path, cols)


WIDE = """select event_id, user_id as site, ts as time, case when event_type = 'click' and k % 2 = 0 then value end as c, case when event_type = 'click' then value + 1 end as c2,
    case when event_type = 'error' then value end as e, k from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)"""


def wide(t):
    k = F.col("k")
    return t.base.select(
        "site", "time", F.when((F.col("pcode") == "click") & (k % 2 == 0), F.col("value")).alias("63680"), F.lit("A").alias("63680_cd"),
        F.when(F.col("pcode") == "click", F.col("value") + 1).alias("63680_bgc"), F.when(F.col("pcode") == "error", F.col("value")).alias("00060_ysi"),
        F.concat(F.lit("P, "), k.cast("string")).alias("00060_ysi_cd"))


@query("src_wide_to_long", f"""select site, time, case when e is null then '63680' else '00060' end as pcode, coalesce(c, c2, e) as value, case when e is not null then 'P, ' || cast(k as varchar) when c is not null then 'A' end as approval_status
    from ({WIDE}) where c2 is not null or e is not null""")
def _(t):
    return S.wide_to_long(wide(t), "site", "time", ["63680", "00060", "00095"]).select("site", "time", "pcode", "value", "approval_status")


@query("src_primary_sensor", f"""select site, time, '63680' as pcode, c as value, '63680' as source_column from ({WIDE}) where c is not null
    union all select site, time, '00060', e, '00060_ysi' from ({WIDE}) where e is not null""")
def _(t):
    return S.primary_to_long(wide(t), "site", "time", ["63680", "00060", "00095"])


@query("src_discrete_route", """select pos, coalesce(case param_code when '80154' then 'ssc' when '00665' then 'total_phosphorus' end, param_code,
    case char_name when 'Total suspended solids' then 'ssc' when 'Phosphorus' then 'total_phosphorus' end) as param from v_labraw""")
def _(t):
    return t.labraw.select("pos", N.parameter_of("param_code", "char_name").alias("param"))


@query("src_partition_write", "select pcode, cast(year(time) as int) as year, count(*) as n, R(sum(value), 2) as total, count(distinct site) as sites from v_obs group by 1, 2")
def _(t):
    from freshet.functions.basics import r

    path = scratch(t.spark, "series")
    S.write_series(t.obs.select(*COLS), path)
    d = t.spark.read.parquet(path)
    return d.groupBy("pcode", "year").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"), F.countDistinct("site").alias("sites"))


@query("src_incremental", "select site, pcode, time, value, event_id from v_obs")
def _(t):
    src, dst, ck = scratch(t.spark, "in"), scratch(t.spark, "out"), scratch(t.spark, "ck")
    cols = ["site", "pcode", "time", "value", "event_id"]
    d = t.obs.select(*cols)
    d.where("k < 50").select(*cols).write.mode("append").parquet(src)
    args = (t.spark, src, dst, ck, d.schema, ["site", "pcode", "time"], ["event_id"])
    I.ingest(*args)
    d.select(*cols).write.mode("append").parquet(src)  # overlaps what was ingested before
    I.ingest(*args)
    I.ingest(*args)  # nothing new: no batch
    return I.ingested(t.spark, dst, ["site", "pcode", "time"], ["event_id"]).select(*cols)


@query("src_prepaired", """select site, time as sample_time, y as lab_value, turb as turbidity_instant, cast(null as double) as window_mean, 'continuous' as turb_source from v_pred
    union all select l_suppkey, l_shipdate, l_quantity, l_extendedprice, null, 'discrete' from lineitem""")
def _(t):
    paired = t.pred.select("site", F.col("time").alias("sample_time"), F.col("y").alias("lab_value"), F.col("turb").alias("turbidity_instant"),
                           F.lit(None).cast("double").alias("window_mean"), F.lit("continuous").alias("turb_source"))
    m = {"site": "l_suppkey", "sample_time": "l_shipdate", "lab_value": "l_quantity", "turbidity_instant": "l_extendedprice"}
    return paired.unionByName(S.adapt_prepaired(t.table("lineitem"), m, {"turb_source": "discrete"}, paired))


SINK = "select oid, site, time, y, case when oid % 5 = 0 then null else p end as p, method from v_pred"


def _sink(kind):
    def run(t):
        d = t.pred.select("oid", "site", "time", "y", F.when(F.col("oid") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p")).alias("p"), "method")
        return S.load(t.spark, S.save(d, scratch(t.spark, kind), kind), kind, d.schema)

    return run


for _kind in ("parquet", "csv", "json"):
    query(f"sink_{_kind}", SINK)(_sink(_kind))
