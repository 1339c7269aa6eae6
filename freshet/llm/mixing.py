"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The rates closest to 1 in relative entropy that give a source its target number of words are
exponentially tilted: ``min(most, exp(tilt * size / mean size))``. The tilt solves the convex
dual of the source's token constraint; Newton steps find it from sums over (source, size) cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.llm.common import WORD, kept, settle

#: Weights of the sources in code point order, repeating; NULL comes last.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: Most copies of a document, and most words of a source for each that it has.
MOST = 2
#: Cells of one source spread over so many groups in the Newton sums.
SALT = 16
TOLERANCE = 1e-10


def sizes(text: str = "text") -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(rows: DataFrame, source: str = "source", size: str = "size", share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, sid, source_size, target)``: shares by weight; what lies above ``most`` times a source's size is shared anew.

    A table with one row per source. Each round is one aggregate over it; the set of capped
    sources only grows, so the rounds end.
    """
    per = rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    table = settle(per.withColumn("sid", order - 1).withColumn("weight", cycle).withColumn("cap", F.col("source_size") * float(most)))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level if capped >= 0 else F.lit(False)
        used, open_weight, n = table.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))
        ).first()
        if not open_weight or n == capped:
            break
        level, capped = (share * total - used) / open_weight, n
    return table.withColumn("target", F.least("cap", F.col("weight") * level)).drop("weight", "cap")


def tilts(cells: DataFrame, wanted: DataFrame, most: int = MOST, rounds: int = 60) -> DataFrame:
    """``(sid, tilt, scale, full)``: the dual solution of every source, by Newton steps kept inside a bracket.

    ``cells`` holds ``sid, size, n``. A source whose target is all that ``most`` copies give is
    ``full``: its tilt would be infinite. Each step joins the tilts to salted cells, sums value and
    slope, and is checkpointed.
    """
    salted = cells.withColumn("salt", F.pmod("size", F.lit(SALT)).cast("int"))
    shape = cells.groupBy("sid").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    inf = F.lit(float("inf"))
    now = wanted.where("source_size > 0").join(shape, "sid").select(
        "sid", "scale", "target", (F.col("target") >= F.col("source_size") * float(most) * (1 - TOLERANCE)).alias("full"),
        F.lit(0.0).alias("tilt"), (-inf).alias("lo"), inf.alias("hi"), inf.alias("miss"),
    )
    now = settle(now)
    for _ in range(rounds):
        live = now.where(~F.col("full") & (F.col("miss") > TOLERANCE))
        if live.isEmpty():
            break
        spread = live.select("sid", "scale", "tilt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        mass = F.col("n") * F.col("size")
        sums = salted.join(spread, ["sid", "salt"]).groupBy("sid").agg(
            F.sum(mass * F.least(F.lit(float(most)), rate)).alias("value"), F.sum(F.when(rate < most, mass * x * rate).otherwise(0.0)).alias("slope")
        )
        gap = F.col("value") - F.col("target")
        lo = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap < 0, F.col("hi")).otherwise(F.col("tilt"))
        stepped = now.join(sums, "sid", "left").withColumn("lo", F.when(F.col("value").isNull(), F.col("lo")).otherwise(lo)).withColumn(
            "hi", F.when(F.col("value").isNull(), F.col("hi")).otherwise(hi)
        )
        newton = F.col("tilt") - gap / F.nullif("slope", F.lit(0.0))
        inside = F.when(F.col("lo") == -inf, F.col("hi") * 2 - 1).when(F.col("hi") == inf, F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        good = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        stepped = stepped.withColumn("miss", F.when(F.col("value").isNull(), F.col("miss")).otherwise(F.abs(gap) / F.col("target")))
        done = F.col("value").isNull() | (F.col("miss") <= TOLERANCE)
        stepped = stepped.withColumn("tilt", F.when(done, F.col("tilt")).when(good, newton).otherwise(inside))
        now = settle(stepped.select(*now.columns))
    return now.select("sid", F.round("tilt", 9).alias("tilt"), "scale", "full")  # sums in another order agree on these digits


def _rounded(cells: DataFrame, wanted: DataFrame, most: int, mends: int = 3) -> DataFrame:
    """Whole copies of each cell: running sums of the rates, longest documents first, then a few mends.

    The running sums leave an error below one longest document; a mend picks, for each source,
    the cell whose copies bring the words closest to the target.
    """
    before = W.partitionBy("sid").orderBy(F.col("size").desc())
    run = F.round(F.sum(F.col("n") * F.col("rate")).over(before.rowsBetween(W.unboundedPreceding, 0)), 6)
    prior = F.coalesce(F.lag("run").over(before), F.lit(0.0))
    whole = cells.withColumn("run", run).withColumn("copies", F.floor(F.col("run") + 0.5) - F.floor(prior + 0.5)).drop("run")
    whole = settle(whole.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), F.col("n") * most)))
    for _ in range(mends):
        used = whole.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("used"))
        lack = wanted.join(used, "sid").select("sid", (F.col("target") - F.col("used")).alias("lack"))
        lack = lack.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        room = F.when(F.col("lack") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        move = F.least(room, F.round(F.abs("lack") / F.col("size")).cast("bigint"))
        left = F.abs(F.abs("lack") - move * F.col("size"))
        tried = whole.withColumn("salt", F.pmod("size", F.lit(SALT)).cast("int")).join(lack, ["sid", "salt"]).withColumn("move", move)
        best = tried.where("move > 0").withColumn("left", left).where(F.col("left") < F.abs("lack")).groupBy("sid").agg(
            F.min(F.struct("left", (-F.col("size")).alias("minus"), (F.col("move") * F.signum("lack").cast("bigint")).alias("move"))).alias("best")
        )
        best = best.select("sid", (-F.col("best.minus")).alias("size"), F.col("best.move").alias("move"))
        whole = settle(whole.join(best, ["sid", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move"))
    return whole


def mix(rows: DataFrame, keys: list[str], source: str = "source", size: str = "size", share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``keys``, ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` of every row.

    ``rows`` holds the keys, the source and the size. Rows of one source and size share a rate;
    which of them get the odd copy is drawn by the hash of their keys, so reruns agree. Rows
    without words get rate 1 and no copies; a NULL source is a source of its own; equal rows are
    counted each; no rows give no rows.
    """
    base = rows.select(*keys, F.col(source).alias("_source"), F.col(size).alias("size"))
    wanted = targets(base, "_source", "size", share, weights, most)
    names = wanted.select("sid", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_name"), "source_size", "target")
    n = base.count()
    bucket = F.pmod(F.xxhash64(*keys, F.lit(5)), F.lit(max(1, -(-n // 20_000)))).cast("int")
    base = base.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit(""))).drop("_source").withColumn("_bucket", bucket)
    counts = base.where("size > 0").groupBy("_name", "size", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts.join(names.select("_name", "sid"), "_name").drop("_name"))
    cells = settle(counts.groupBy("sid", "size").agg(F.sum("n").alias("n")))
    tilt = tilts(cells, wanted, most)
    spread = tilt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    rated = cells.withColumn("salt", F.pmod("size", F.lit(SALT)).cast("int")).join(spread, ["sid", "salt"]).select("sid", "size", "n", rate.alias("rate"))
    whole = _rounded(rated, wanted, most)
    earlier = W.partitionBy("sid", "size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(whole, ["sid", "size"])
    starts = starts.select("sid", "size", "_bucket", "start", "rate", F.floor(F.col("copies") / F.col("n")).alias("each"), F.pmod("copies", "n").alias("odd"))
    per = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    known = base.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int")).join(per, ["_name", "salt"])
    inside = F.row_number().over(W.partitionBy("sid", "size", "_bucket").orderBy(F.xxhash64(*keys, F.lit(6)), *keys))
    ranked = known.withColumn("_inside", inside).join(starts, ["sid", "size", "_bucket"], "left")
    copies = F.col("each") + (F.col("start") + F.col("_inside") <= F.col("odd")).cast("bigint")
    return ranked.select(*keys, "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"), F.coalesce(copies, F.lit(0)).cast("bigint").alias("copies"))


def repeated(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; columns come back as they are."""
    from freshet.llm.common import row_key

    k1, k2 = row_key(docs)
    rows = kept(docs.select(k1.alias("_k1"), k2.alias("_k2"), F.col(f"`{source}`").alias("src"), sizes(f"`{text}`").alias("size")), "sizes")
    taken = mix(rows, ["_k1", "_k2"], "src").groupBy("_k1", "_k2").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    cols = [F.col(f"`{n}`") for n in docs.columns]
    one = docs.select(*cols, k1.alias("_k1"), k2.alias("_k2")).join(taken, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return one.select(*cols, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*cols)
