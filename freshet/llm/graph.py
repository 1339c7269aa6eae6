"""Connected components by alternating large and small stars, all in DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _star(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) becomes (v, least neighbour of u); a node with many neighbours is one aggregated row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("hi") != F.col("lo")).select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge list; the component is its smallest node.

    Self links and repeated or reversed edges are allowed; NULL ends are left out; an empty
    list gives no rows. No edge list of one node is gathered: a hub's edges go through an
    aggregate and a join that adaptive execution can split. Each round is checkpointed, so
    a lost executor costs one round.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = settle(_tidy(ends.select(F.col(a).alias("hi"), F.col(b).alias("lo"))))
    seen = _state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _tidy(
            _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.least("m", "u").alias("lo"))
        )
        down = _star(large.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        ends = F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("v").alias("hi"), F.col("m").alias("lo"))))
        now = settle(_tidy(down.select(ends.alias("e")).select("e.hi", "e.lo")))
        last, seen = seen, _state(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    top = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(top)
