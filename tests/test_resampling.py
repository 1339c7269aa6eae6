"""Medians of resampled entities are made in tasks that hold some replicates; draws are no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from freshet.operators import adapt as AD, bootstrap as B, sampling as S


@pytest.fixture(scope="module")
def scores(spark):
    """Groups of unlike size, repeated and missing values, a missing label and a site without a number."""
    d = spark.range(400).selectExpr("id % 97 as site", "concat('g', id % 4) as label", "if(id % 11 = 3, null, cast(id * 37 % 53 as double)) as nse", "id")
    d = d.where("label <> 'g3' or site < 5").dropDuplicates(["site", "label"])
    return d.selectExpr("if(site = 8, null, site) as site", "if(label = 'g1' and site > 60, null, label) as label", "nse")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def same(got, want):
    assert len(got) == len(want) > 2
    for a, b in zip(got, want):
        assert all(x == z or x == pytest.approx(z, rel=1e-12) for x, z in zip(a, b)), (a, b)


@pytest.fixture
def cut(monkeypatch):
    monkeypatch.setattr(S, "REPS", 7)
    monkeypatch.setattr(S, "PACKED", 16)


def test_curve_interval_is_that_of_drawn_rows(scores, cut, monkeypatch):
    run = lambda: rows(AD.curve(scores.where("label is not null and site is not null"), "site", ["nse"], ["label"], reps=60))
    got = run()
    monkeypatch.setattr(S, "HELD", 0)
    same(got, run())


def test_group_medians_are_those_of_drawn_rows(scores, cut, monkeypatch):
    run = lambda: rows(B.median_by_group(scores, "site", ["label"], "nse", 42, 60))
    got = run()
    monkeypatch.setattr(B, "HELD", 0)
    same(got, run())


def test_no_draw_is_a_row(scores):
    num = S.number_in(scores.dropna(), ["label"], [F.lit("42"), "site"], "site")
    plan = S.resampled_medians(num, ["label"], "_rn", "_m", "nse", 42, 1000, 100)._jdf.queryExecution().executedPlan().toString()
    made = plan[: plan.find("collect_list")]  # what follows the packed rows
    assert "MapInArrow" in made and made.count("Generate") == 1 and "md5" not in made and "Join" not in made
