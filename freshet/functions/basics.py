"""Small Column helpers shared by every operator."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DAY = 86_400
HOUR = 3_600


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(t: str | Column) -> Column:
    """Microseconds since the epoch as a long (NTZ is read as UTC)."""
    return F.unix_micros(c(t).cast("timestamp"))


def seconds(t: str | Column) -> Column:
    return micros(t) / F.lit(1e6)


def time_block(t: str | Column, width_s: float) -> Column:
    """Index of the fixed-width time slice that holds ``t``."""
    return F.floor(micros(t) / F.lit(int(width_s * 1_000_000)))


def value_block(v: str | Column, per_octave: int = 512) -> Column:
    """Monotone, stateless slice number of a double on a signed log scale."""
    x = c(v).cast("double")
    return F.floor(F.signum(x) * F.log2(F.abs(x) + 1.0) * F.lit(float(per_octave))).cast("long")


def r(x: str | Column, digits: int = 4) -> Column:
    """Round with a threshold off the half, so short decimals never tie.

    Values that have no such digits (beyond 2^53 units of the last one) and NaN come back as they are.
    """
    s = float(10**digits)
    v = c(x).cast("double")
    return F.when(F.abs(v) < F.lit(float(1 << 53) / s), F.floor(v * F.lit(s) + F.lit(0.4873)) / F.lit(s)).otherwise(v)


def sig(x: str | Column, digits: int = 6) -> Column:
    """The value to so many significant digits: for numbers whose size is not known beforehand.

    It is first moved by 1e-10 of itself, so that short decimals never tie.
    """
    v = c(x).cast("double") * F.lit(1.0 + 1e-10)
    return F.when(v.isNotNull(), F.format_string(f"%.{digits - 1}e", v).cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero or missing."""
    return c(a).cast("double") / F.nullif(c(b).cast("double"), F.lit(0.0))


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    x = c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def draw_hex(*parts: str | Column) -> Column:
    """The draw as eight hexadecimal digits, which sort as the number does."""
    return F.substring(F.md5(F.concat_ws(":", *[c(p).cast("string") for p in parts])), 1, 8)


def draw(*parts: str | Column) -> Column:
    """Reproducible 32-bit draw from stable keys (md5, no generator state)."""
    return F.conv(draw_hex(*parts), 16, 10).cast("long")


def clean(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column; the library never carries NaN."""
    return df.select(
        *[
            F.when(~F.isnan(n), F.col(n)).alias(n) if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes
        ]
    )


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate (means, thresholds, counts).

    Plain values are read once - one row, whatever the size of the data - and become
    literals: the aggregate runs a single time however often its columns are used, and
    filters on them reach the scan. Arrays and structs go in as a scalar subquery.
    """
    if any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) for f in one_row.schema.fields):
        s = one_row.select(F.struct(*one_row.columns).alias("_scalar_row")).scalar()
        out = df.withColumn("_scalar_row", s)
        return out.select(*df.columns, *[F.col("_scalar_row")[n].alias(n) for n in one_row.columns])
    row = one_row.first()
    cols = [F.lit(None if row is None else row[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields]
    return df.select(*df.columns, *cols)


def by_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the group keys; without keys the right side is the one row of the only group.

    Plain equality keeps the partitioning of an earlier window or aggregate usable. A
    NULL key matches nothing: as in the aggregates of the reference data model, rows
    without an entity belong to no group.
    """
    if keys:
        return a.join(b, keys, how)
    return with_scalar(a, b)


def spread_join(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join rows with a table of one row per key so that the rows of one key meet it in many tasks.

    The small side is copied once for each salt. What follows is partitioned by key and salt, so an
    aggregate by key combines rows where they are before it shuffles.
    """
    rest = [x for x in rows.columns if x not in keys] or keys
    a = rows.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    b = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, *cols: str, rows: int = 0) -> DataFrame:
    """``df`` in a named number of tasks, so that few rows which each become many are not left to one; ``rows`` is how many they become."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism, rows // 4_000_000)
    return df.repartition(tasks, *cols)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables that all executors reach.

    Named by ``spark.checkpoint.dir``. Only where none is set and Spark runs on this machine
    alone, a folder under the warehouse is taken.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if sc.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        sc.setCheckpointDir(f"{warehouse}/_checkpoints/{sc.applicationId}")
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused, so retries cannot collide."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint an expensive result that several branches of a plan read."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``settle``, as a table under the shared folder: columns are packed, and each branch reads only those it needs."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
