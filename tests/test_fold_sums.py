"""Bias corrections of left-out folds: sums of a series, within rounding what scoring every row by every fold gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from freshet.operators import regression as G


def table(spark, shift, sites=40):
    """Sites of unlike size; ``shift`` moves the target, so that with a low one some predictions are cut off at zero."""
    rng = np.random.default_rng(4)
    rows = []
    for site in range(sites):
        for _ in range(300 if site == 0 else 6 + site % 5):
            x, z = rng.normal(), rng.lognormal(0, 0.8)
            rows.append((site, x, z, float(max(0.0, shift + 3 * x + z + rng.normal() * (4 if site == 0 else 1)))))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["site", "x", "z", "y"]))


@pytest.mark.parametrize("kind,lam", [("log1p", None), ("boxcox", 0.2), ("boxcox", 0.5), ("boxcox", 0.37), ("boxcox", -0.3), ("boxcox", 0.0)])
@pytest.mark.parametrize("shift", [40.0, 2.0])
def test_series_is_every_row_by_every_fold(spark, monkeypatch, kind, lam, shift):
    run = lambda: {r.site: r for r in G.ridge_logo(table(spark, shift), "site", ["x", "z"], {}, "y", kind=kind, lam=lam).collect()}
    got = run()
    monkeypatch.setattr(G, "TERMS", 0)
    want = run()
    assert set(got) == set(want) and len(got) == 40
    assert all(got[k].factor == pytest.approx(want[k].factor, rel=1e-11) for k in want)


def test_folds_are_not_scored_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(G, "_scored_by_each", lambda rows, folds, *_: pytest.fail("scored") if folds.count() > 1 else None)
    assert G.ridge_logo(table(spark, 60.0), "site", ["x", "z"], {}, "y", kind="boxcox", lam=0.2).where("site > 0").count() == 39
