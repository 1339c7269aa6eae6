"""Readers and writers for sensor chunks, lab exports and attribute files."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from freshet.functions.basics import clean
from freshet.operators.blocks import keep_first

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SERIES = T.StructType([
    T.StructField("site", T.LongType()), T.StructField("pcode", T.StringType()), T.StructField("time", T.TimestampNTZType()),
    T.StructField("value", T.DoubleType()), T.StructField("approval_status", T.StringType()), T.StructField("qualifier", T.StringType()),
])


def read_chunks(spark: SparkSession, path: str, schema: T.StructType = SERIES) -> DataFrame:
    """All chunk files of a series tree; the first row per time in path order wins."""
    d = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    d = d.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    return keep_first(d, ["site", "pcode", "time"], ["_f", "_i"]).drop("_f", "_i")


def read_lab_tree(spark: SparkSession, path: str, schema: T.StructType, pattern: str, names: list[str]) -> DataFrame:
    """One glob read of per-entity lab files; identity columns come from the path."""
    d = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    p = F.col("_metadata.file_path")
    return d.select("*", *[F.regexp_extract(p, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", encoding: str = "ISO-8859-1", required: list[str] | None = None) -> DataFrame:
    """CSV or TSV with declared types (keys stay text) and required columns."""
    d = spark.read.schema(schema).csv(path, sep=sep, encoding=encoding, header=True, mode="PERMISSIVE", enforceSchema=True)
    return clean(d.dropna(subset=required) if required else d)


def read_rdb(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab text with # comments, a header line and a `5s 15s` format line; short rows are padded."""
    schema = T.StructType([T.StructField(x, T.StringType()) for x in columns])
    d = spark.read.schema(schema).csv(path, sep="\t", comment="#", mode="PERMISSIVE")
    first = F.col(columns[0])
    return d.where(first.isNotNull() & (first != columns[0]) & ~first.rlike(r"^\d+[sdn]$"))


def sensor_columns(columns: list[str], codes: list[str]) -> dict[str, list[str]]:
    """Value columns per parameter code, in file order: `code`, `code_variant`, never `_cd`."""
    out: dict[str, list[str]] = {}
    for x in columns:
        if not x.endswith("_cd") and x.split("_")[0] in codes:
            out.setdefault(x.split("_")[0], []).append(x)
    return out


def primary_column(columns: list[str], code: str) -> str | None:
    """The plain parameter column, else its first variant."""
    if code in columns:
        return code
    return next((x for x in columns if x.startswith(code) and not x.endswith("_cd")), None)


def wide_to_long(df: DataFrame, site: str, t: str, codes: list[str]) -> DataFrame:
    """Wide batch to series rows; variants of a sensor merge, the first in column order wins."""
    cells = []
    for code, cols in sensor_columns(df.columns, codes).items():
        for i, x in enumerate(cols):
            cd = F.col(f"{x}_cd") if f"{x}_cd" in df.columns else F.lit(None).cast("string")
            cells.append(F.struct(F.lit(code).alias("pcode"), F.lit(i).alias("_i"), F.col(x).try_cast("double").alias("value"), cd.cast("string").alias("approval_status")))
    d = df.select(site, t, F.inline(F.array(*cells))).where(F.col("value").isNotNull() & F.col(t).isNotNull())
    return keep_first(d, [site, "pcode", t], ["_i"]).drop("_i")


def primary_to_long(df: DataFrame, site: str, t: str, codes: list[str]) -> DataFrame:
    """Only the primary sensor of each parameter."""
    cells = []
    for code in codes:
        x = primary_column(df.columns, code)
        if x:
            cells.append(F.struct(F.lit(code).alias("pcode"), F.col(x).try_cast("double").alias("value"), F.lit(x).alias("source_column")))
    return df.select(site, t, F.inline(F.array(*cells))).where("value is not null")


def write_series(df: DataFrame, path: str, t: str = "time") -> None:
    """Series tree partitioned by parameter and year, clustered by site.

    The rebalance hint lets adaptive execution split a directory that holds much of the
    table over several tasks instead of one.
    """
    d = df.withColumn("year", F.year(t)).hint("rebalance", "pcode", "year")
    d.sortWithinPartitions("pcode", "year", "site", t).write.mode("overwrite").partitionBy("pcode", "year").parquet(path)


def adapt_prepaired(df: DataFrame, mapping: dict[str, str], constants: dict[str, object], like: DataFrame) -> DataFrame:
    """Already paired study data to the paired schema: rename, constants, NULL for the rest."""
    cols = []
    for f in like.schema.fields:
        if f.name in mapping:
            cols.append(F.col(mapping[f.name]).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(constants.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def save(df: DataFrame, path: str, kind: str) -> str:
    """Parquet, CSV or JSON lines, NaN stored as missing."""
    w = clean(df).write.mode("overwrite").option("timestampNTZFormat", STAMP)
    if kind == "csv":
        w.csv(path, header=True)
    elif kind == "json":
        w.option("ignoreNullFields", "false").json(path)
    else:
        w.parquet(path)
    return path


def load(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    r = spark.read.schema(schema).option("timestampNTZFormat", STAMP)
    if kind == "csv":
        return r.csv(path, header=True)
    return r.json(path) if kind == "json" else r.parquet(path)


