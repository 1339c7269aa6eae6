"""Jump consistent hashing of stable keys to shards, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.llm.common import kept

#: The generator's multiplier, as published with the method.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
#: Steps of the walk done at once. It takes about ln(shards) of them; the few rows that need more go on.
STEPS = 40
#: Rows that are numbered in one group.
SLOT_ROWS = 20_000


def _step(s: Column) -> Column:
    """key = key * MULTIPLIER + 1 modulo 2^64 in 32-bit halves (no overflow under ANSI), then the next jump."""
    hi, lo = s["hi"], s["lo"]
    c1, c0 = MULTIPLIER >> 32, MULTIPLIER & LOW

    def low_product(x: Column, c: int) -> Column:
        return x * (c & 0xFFFF) + F.shiftleft((x * (c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)

    p1 = lo * (c0 >> 16)
    sum0 = lo * (c0 & 0xFFFF) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    sum1 = F.shiftright(sum0, 32) + F.shiftright(p1, 16) + low_product(hi, c0) + low_product(lo, c1)
    new_hi = sum1.bitwiseAND(F.lit(LOW))
    jump = ((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1).cast("double"))).cast("bigint")
    return F.struct(new_hi.alias("hi"), sum0.bitwiseAND(F.lit(LOW)).alias("lo"), s["j"].alias("b"), jump.alias("j"))


def jump_walk(key: Column, shards: int) -> Column:
    """The end of the walk for a 64-bit key: ``b`` is the shard, ``j`` the next jump (``shards`` or more)."""
    if not 1 <= shards < 1 << 31:
        raise ValueError("shards must lie in 1..2^31 - 1")
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"), zero.alias("b"), zero.alias("j"))

    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: F.when(s["j"] < shards, _step(s)).otherwise(s))

    done = walk(start, min(STEPS, shards))
    return done if shards <= STEPS else F.when(done["j"] < shards, walk(done, shards)).otherwise(done)


def assign(docs: DataFrame, key: str, shards: int) -> DataFrame:
    """All columns with ``shard`` and ``grown_shard``, the shard if one more is appended.

    The walk for one more shard is the same but for its last jump, so both come from one walk:
    a row either stays or moves into the new shard. NULL keys share one shard; equal keys do too.
    """
    out = docs.withColumn("_walk", jump_walk(F.xxhash64(F.col(f"`{key}`")), shards))
    moved = F.when(F.col("_walk.j") == shards, F.lit(shards)).otherwise(F.col("_walk.b"))
    return out.withColumn("shard", F.col("_walk.b").cast("int")).withColumn("grown_shard", moved.cast("int")).drop("_walk")


def with_slots(rows: DataFrame, group: str, order: list[str], out: str = "slot", most: int = SLOT_ROWS) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without gathering a group.

    Rows are dealt by a hash of ``order`` into as many buckets as keep one near ``most`` rows;
    buckets are counted, their counts summed up, and rows numbered inside them.
    """
    dealt = kept(rows, "slots")
    n = dealt.count()
    bucket = F.pmod(F.xxhash64(*order, F.lit(3)), F.lit(max(1, -(-n // most)))).cast("int")
    dealt = dealt.withColumn("_bucket", bucket)
    counts = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order))
    numbered = dealt.withColumn("_inside", inside)
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_at")))
    return joined.select(*[F.col(f"`{n}`") for n in rows.columns], (F.col("_start") + F.col("_inside") - 1).cast("bigint").alias(out))
