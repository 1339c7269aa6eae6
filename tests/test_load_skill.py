"""Rank correlations of groups ranked where they lie and of groups cut into slices."""

from __future__ import annotations

import random

from freshet.operators import blocks, loads as L, metrics as M


def rows(spark):
    rng = random.Random(3)
    out = [(s, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for s, n in ((1, 60), (2, 7), (3, 1)) for _ in range(n)]
    return spark.createDataFrame([*out, (None, 1.0, 2.0), (None, 3.0, 4.0), (4, None, 1.0)], "site long, y double, p double")


def found(df) -> dict:
    return {r.site: None if r.rho is None else round(r.rho, 9) for r in M.spearman(df, ["site"], "y", "p", "rho").collect()}


def test_rank_correlation_does_not_depend_on_the_size_that_is_cut(spark, monkeypatch):
    d = rows(spark)
    got = found(d)
    want = {k: round(x.y.corr(x.p, method="pearson"), 9) for k, x in d.toPandas().dropna().groupby("site")[["y", "p"]].rank().assign(site=d.toPandas().dropna().site).groupby("site") if k < 3}
    assert got == {**want, 3: None, None: None}
    monkeypatch.setattr(blocks, "TARGET", 20)
    assert found(d) == got


def test_small_groups_are_exchanged_once(spark):
    d = rows(spark).where("site is not null")
    p = M.spearman(d, ["site"], "y", "p", "rho")._jdf.queryExecution().executedPlan().toString()
    # the first branch, up to the list of large groups, moves its rows by site and by nothing else
    first = p.split("BroadcastHashJoin")[0]
    assert first.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in first


def test_load_metrics_read_the_pairs_from_a_table(spark):
    p = L.load_metrics(rows(spark), ["site"], "y", "p", 2)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in p and "Scan ExistingRDD" not in p
