"""Registered queries against their SQL. FRESHET_FULL=1 runs every one of them."""

from __future__ import annotations

import os

import pytest

from check import compare
from freshet.catalog import ORACLE, QUERIES

SOME = """norm_utc norm_qualifier nondetect_dl2 attr_map fx_inverse fx_impute fx_bin_qcut qc_buffer qc_stats qc_site_tiers
dedup_conflict union_common_cols set_lost_gained join_interp join_asof_nearest join_asof_last join_window_stats join_align
join_nearest_geo join_point_in_polygon join_in_range win_antecedent win_rain_lag win_centered win_rolling_min win_sessionize
win_halves win_qq grid_interp load_rating_curve load_metrics evt_detect evt_top_per_site agg_site_metrics agg_summary agg_hist
smp_stratified_holdout smp_calibration smp_bootstrap_median reg_site_ols reg_global_pooled reg_global_logo adapt_bayes
adapt_random_intercept pi_mondrian_fit pi_interp pi_cqr_qhat dia_disaggregate dia_first_flush app_score st_spearman st_wilcoxon
st_kruskal dq_paired dq_qualify dq_hash top_n src_chunks src_rdb src_wide_to_long src_incremental sink_json ml_prepare ml_score
flow_flagship""".split()
NAMES = list(ORACLE) if os.environ.get("FRESHET_FULL") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, sf_dir, name):
    ok, msg = compare(spark, duck, name, sf_dir)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
