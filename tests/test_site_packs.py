"""Sets are drawn, fitted and scored where the rows of their site lie; nothing grows with the number of trials but the result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from freshet.catalog import QUERIES
from freshet.operators import trials as T
from freshet.plans import compare

from test_adaptation import pred  # noqa: F401


def drawn(pred, modes=T.MODES):  # noqa: F811
    rows = T.calibration_sets(pred, "site", "oid", "time", ["x", "y", "p", "t"], T.SIZES, 4, list(modes), 7).collect()
    return {(r.site, r["mode"], r.n, r.trial): (r.season, [tuple(c) for c in r.cal]) for r in rows}


def test_large_sites_draw_the_same_sets(pred, monkeypatch):  # noqa: F811
    whole = drawn(pred)
    monkeypatch.setattr(T, "SITE", 16)  # sites a and c are cut into blocks, b is not
    assert drawn(pred) == whole and len(whole) > 100


def test_large_sites_have_the_same_scores(pred, monkeypatch):  # noqa: F811
    args = ("site", "oid", "time", ["x", "y", "p", "t"], T.SIZES, 3, T.MODES, 7, T.fit_bayes, T.line_matrix(), ("y", "p"))
    table = lambda: {(r.site, r["mode"], r.n): r for r in T.site_scores(pred, *args).collect()}
    both = lambda: {r.site: r for r in compare.curve_versus_model(pred, "site", "oid", "time", ["x", "y", "p", "t"], [3], 4, ["random"], 7).collect()}
    whole, one = table(), both()
    monkeypatch.setattr(T, "SITE", 16)
    cut, other = table(), both()
    assert set(whole) == set(cut) and set(one) == set(other) == {"a", "b", "c"}
    for k, r in whole.items():
        assert r.n_trials == cut[k].n_trials
        for x in T.SCORES:
            assert (cut[k][x] is None if r[x] is None else cut[k][x] == pytest.approx(r[x], rel=1e-8, abs=1e-8)), (k, x)
    for k, r in one.items():
        for x in compare.OUT:
            assert other[k][x] == pytest.approx(r[x], rel=1e-8, abs=1e-8), (k, x)


def test_medians_over_trials_are_those_of_the_sets(pred):  # noqa: F811
    args = ("site", "oid", "time", ["x", "y", "p", "t"], [0, 1, 3], 5, ["random", "temporal_block"], 7, T.fit_linear, T.line_matrix(), ("y", "p"))
    each = T.site_scores(pred, *args, names=T.SCORES, over=False)
    want = {(r.site, r["mode"], r.n): r for r in T.over_trials(each, "site").collect()}
    got = {(r.site, r["mode"], r.n): r for r in T.site_scores(pred, *args).collect()}
    assert set(got) == set(want) and len(got) > 8
    for k, r in want.items():
        assert got[k].n_trials == r.n_trials and all(got[k][x] == pytest.approx(r[x], nan_ok=True) if r[x] is not None else got[k][x] is None for x in T.SCORES)


@pytest.mark.parametrize("name", ["smp_calibration", "adapt_shrinkage", "adapt_linear", "reg_ols_benchmark", "reg_usgs_compare"])
def test_rows_move_once_and_sets_never(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_sets_are_not_moved_to_their_months(spark, sf_dir):
    d = QUERIES["smp_trials"](spark, sf_dir)
    plan = d._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert d.where(F.col("n_cal") == 0).count() > 0
