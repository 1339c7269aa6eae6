"""The library's logical tables, derived from the generated benchmark tables.

Each view exists twice: as a DataFrame (`Testbed`) and as SQL text (`VIEWS`), so that a
query and its SQL check start from the same rows.

v_obs     sensor readings     events other than purchases
v_lab     lab samples         purchases, with exact and conflicting copies
v_labraw  raw lab strings     purchases written as a lab export
v_daily   daily weather       events per site and day
v_sites   site attributes     customers, ten per site
v_pred    scored readings     orders, site = ten customers
v_flow    daily flow series   line items per supplier and ship day
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

VIEWS: dict[str, str] = {
    "v_base": """select event_id, user_id as site, event_type as pcode, ts as time, value,
        cast(json_extract_string(props, '$.k') as int) as k from events""",
    "v_obs": """select site, pcode, time, event_id, k,
        case when k = 97 then null when k = 96 then -value else value end as value,
        case k % 10 when 6 then 'Approved' when 7 then 'A, R' when 8 then 'P' when 9 then 'Provisional' else 'A' end
          as approval_status,
        case k % 17 when 0 then 'Ice' when 1 then '[''MAINT'' ''ESTIMATED'']' when 2 then 'Fld' when 3 then 'Fld,Eqp'
          when 4 then 'e' when 5 then '' end as qualifier
        from v_base where pcode <> 'purchase'""",
    "v_lab": """select site, time, event_id + cast(c as bigint) * 1000000000 as pos, k % 9 = 0 as is_nondetect,
        case when c = 2 then value + 1.0 when k = 95 then null else value end as value,
        case when c = 2 and k % 2 = 0 then 'USGS-A' else 'LAB-' || cast(k % 3 as varchar) end as org, k
        from (select *, unnest([0, 1, 2]) as c from v_base where pcode = 'purchase')
        where c = 0 or (c = 1 and k % 11 = 0) or (c = 2 and k % 13 = 0)""",
    "v_labraw": """select site, event_id as pos, strftime(time, '%Y-%m-%d') as start_date,
        case when k % 31 = 0 then '' when k % 31 = 1 then null else strftime(time, '%H:%M:%S') end as start_time,
        case k % 7 when 0 then 'EST' when 1 then 'CST' when 2 then 'PST' when 3 then 'UTC' when 5 then 'XXX'
          when 6 then 'EDT' end as start_tz,
        case when k % 19 = 0 then 'n/a' when k % 23 = 0 then '0'
          else cast(cast(floor(value) as bigint) as varchar) || '.25' end as measure,
        case k % 9 when 0 then 'Not Detected' when 1 then 'Systematic Contamination' when 2 then null
          when 3 then 'Detected Not Quantified' else '' end as condition,
        case when site % 3 = 0 and k % 2 = 0 then cast(k % 5 as varchar) end as limit_a,
        case when k % 6 = 0 then '4' when k % 6 = 3 then '-1' end as limit_b,
        case k % 8 when 0 then 'Automatic sampler' when 1 then 'US DH-81 wading' when 2 then 'Grab sample bottle'
          when 3 then 'Kemmerer' when 4 then 'Bag sampler' when 5 then null when 6 then 'Bucket'
          else 'Submersible pump' end as equipment,
        case when k % 4 = 0 then 'USGS-WRD' else 'STATE-' || cast(k % 3 as varchar) end as org,
        case k % 5 when 0 then '00530' when 1 then '80154' when 2 then '00665' end as param_code,
        case k % 3 when 0 then 'Total suspended solids' when 1 then 'Phosphorus' else 'Other' end as char_name
        from v_base where pcode = 'purchase'""",
    "v_daily": """select site, cast(time as date) as day, floor(sum(case when pcode = 'error' then value else 0 end) * 2
          + 0.25) / 100 as precip_mm, round(max(value), 2) as tmax_c, round(min(value), 2) as tmin_c
        from v_base group by 1, 2""",
    "v_sites": """select c_custkey // 10 as site, floor(avg(c_acctbal) + 0.37) / 10 as area,
        min(c_nationkey) as nation, min(r_name) as region, max(c_nationkey) as geol,
        count(*) as n_dams, floor(max(c_acctbal)) as dam_storage,
        (c_custkey // 10) * 37 % 101 as clay_pct, (c_custkey // 10) * 53 % 89 as sand_pct,
        25 + ((c_custkey // 10) * 7919 % 2400) / 100.0::double as lat,
        -120 + ((c_custkey // 10) * 104729 % 5000) / 100.0::double as lon
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        group by c_custkey // 10""",
    "v_pred": """select o_custkey // 10 as site, o_orderkey as oid, o_orderdate as time, o_totalprice / 1000 as y,
        o_totalprice / 1000 * (0.6::double + 0.08::double * (o_orderkey % 11)) as p,
        o_totalprice / 1000 * (0.53::double + 0.1::double * (o_orderkey % 7)) as turb,
        cast(10 + o_orderkey * 37 % 500 as double) as flow,
        case o_orderkey % 3 when 0 then 'auto_point' when 1 then 'depth_integrated' else 'grab' end as method,
        case o_orderkey % 5 when 0 then 'exo' when 1 then 'ysi' else 'unknown' end as family,
        cast(o_orderkey * 13 % 97 as double) as dry_days, cast(o_orderkey * 29 % 83 as double) as rain_mm,
        o_orderstatus as status, o_orderpriority as priority
        from orders""",
    "v_flow": """select l_suppkey as site, cast(l_shipdate as date) as day, floor(sum(l_extendedprice) / 10) / 100 as q,
        floor(avg(l_quantity) * 100 + 0.13) / 100 as conc from lineitem group by 1, 2""",
}


class Testbed:
    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int").alias("k")
        return self.table("events").select(
            "event_id", F.col("user_id").alias("site"), F.col("event_type").alias("pcode"),
            F.col("ts").alias("time"), "value", k,
        )

    @cached_property
    def obs(self) -> DataFrame:
        return self.base.where("pcode <> 'purchase'").selectExpr(
            "site", "pcode", "time", "event_id", "k",
            "case when k = 97 then null when k = 96 then -value else value end as value",
            "case k % 10 when 6 then 'Approved' when 7 then 'A, R' when 8 then 'P' when 9 then 'Provisional' "
            "else 'A' end as approval_status",
            "case k % 17 when 0 then 'Ice' when 1 then \"['MAINT' 'ESTIMATED']\" when 2 then 'Fld' when 3 then 'Fld,Eqp' "
            "when 4 then 'e' when 5 then '' end as qualifier",
        )

    @cached_property
    def lab(self) -> DataFrame:
        return (
            self.base.where("pcode = 'purchase'")
            .selectExpr("*", "explode(array(0, 1, 2)) as c")
            .where("c = 0 or (c = 1 and k % 11 = 0) or (c = 2 and k % 13 = 0)")
            .selectExpr(
                "site", "time", "event_id + cast(c as bigint) * 1000000000 as pos", "k % 9 = 0 as is_nondetect",
                "case when c = 2 then value + 1.0 when k = 95 then null else value end as value",
                "case when c = 2 and k % 2 = 0 then 'USGS-A' else 'LAB-' || cast(k % 3 as string) end as org", "k",
            )
        )

    @cached_property
    def lab_clean(self) -> DataFrame:
        """One row per purchase: the lab table without copies and missing values."""
        return self.base.where("pcode = 'purchase'").select(
            "site", "time", F.col("event_id").alias("pos"), F.col("value").alias("lab_value"), "k"
        )

    @cached_property
    def labraw(self) -> DataFrame:
        return self.base.where("pcode = 'purchase'").selectExpr(
            "site", "event_id as pos", "date_format(time, 'yyyy-MM-dd') as start_date",
            "case when k % 31 = 0 then '' when k % 31 = 1 then null else date_format(time, 'HH:mm:ss') end as start_time",
            "case k % 7 when 0 then 'EST' when 1 then 'CST' when 2 then 'PST' when 3 then 'UTC' when 5 then 'XXX' "
            "when 6 then 'EDT' end as start_tz",
            "case when k % 19 = 0 then 'n/a' when k % 23 = 0 then '0' "
            "else cast(cast(floor(value) as bigint) as string) || '.25' end as measure",
            "case k % 9 when 0 then 'Not Detected' when 1 then 'Systematic Contamination' when 2 then null "
            "when 3 then 'Detected Not Quantified' else '' end as condition",
            "case when site % 3 = 0 and k % 2 = 0 then cast(k % 5 as string) end as limit_a",
            "case when k % 6 = 0 then '4' when k % 6 = 3 then '-1' end as limit_b",
            "case k % 8 when 0 then 'Automatic sampler' when 1 then 'US DH-81 wading' when 2 then 'Grab sample bottle' "
            "when 3 then 'Kemmerer' when 4 then 'Bag sampler' when 5 then null when 6 then 'Bucket' "
            "else 'Submersible pump' end as equipment",
            "case when k % 4 = 0 then 'USGS-WRD' else 'STATE-' || cast(k % 3 as string) end as org",
            "case k % 5 when 0 then '00530' when 1 then '80154' when 2 then '00665' end as param_code",
            "case k % 3 when 0 then 'Total suspended solids' when 1 then 'Phosphorus' else 'Other' end as char_name",
        )

    @cached_property
    def daily(self) -> DataFrame:
        return self.base.groupBy("site", F.to_date("time").alias("day")).agg(
            F.expr("floor(sum(case when pcode = 'error' then value else 0 end) * 2 + 0.25) / 100").alias("precip_mm"),
            F.round(F.max("value"), 2).alias("tmax_c"),
            F.round(F.min("value"), 2).alias("tmin_c"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        n, rg = self.table("nation"), self.table("region")
        dim = n.join(F.broadcast(rg), n.n_regionkey == rg.r_regionkey)  # 25 nations, 5 regions by definition
        cu = self.table("customer")
        g = cu.join(F.broadcast(dim), cu.c_nationkey == dim.n_nationkey).groupBy(F.expr("c_custkey div 10").alias("site"))
        return g.agg(
            F.expr("floor(avg(c_acctbal) + 0.37) / 10").alias("area"),
            F.min("c_nationkey").alias("nation"), F.min("r_name").alias("region"), F.max("c_nationkey").alias("geol"),
            F.count("*").alias("n_dams"), F.floor(F.max("c_acctbal")).cast("double").alias("dam_storage"),
        ).selectExpr(
            "*", "site * 37 % 101 as clay_pct", "site * 53 % 89 as sand_pct",
            "25 + (site * 7919 % 2400) / 100.0D as lat", "-120 + (site * 104729 % 5000) / 100.0D as lon",
        )

    @cached_property
    def pred(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey div 10 as site", "o_orderkey as oid", "o_orderdate as time", "o_totalprice / 1000 as y",
            "o_totalprice / 1000 * (0.6D + 0.08D * (o_orderkey % 11)) as p",
            "o_totalprice / 1000 * (0.53D + 0.1D * (o_orderkey % 7)) as turb",
            "cast(10 + o_orderkey * 37 % 500 as double) as flow",
            "case o_orderkey % 3 when 0 then 'auto_point' when 1 then 'depth_integrated' else 'grab' end as method",
            "case o_orderkey % 5 when 0 then 'exo' when 1 then 'ysi' else 'unknown' end as family",
            "cast(o_orderkey * 13 % 97 as double) as dry_days", "cast(o_orderkey * 29 % 83 as double) as rain_mm",
            "o_orderstatus as status", "o_orderpriority as priority",
        )

    @cached_property
    def flow(self) -> DataFrame:
        li = self.table("lineitem")
        return li.groupBy(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("day")).agg(
            F.expr("floor(sum(l_extendedprice) / 10) / 100").alias("q"),
            F.expr("floor(avg(l_quantity) * 100 + 0.13) / 100").alias("conc"),
        )
