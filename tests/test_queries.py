"""Registered queries against their SQL twins. RAMPLAKE_ALL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry_module
from harness import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
CORE = """process_class_support regularize_strict resample_mean_right_closed gap_fill_linear gap_guarded_diff valid_runs horizon_targets sample_index
stage_stats haversine_distance calendar_quarter_local invert_gasf imbalance_cashflow quantile_map power_curve_outliers impute_missing_unit asof_nearest
interval_overlap_join_iou caliper_pairs_self detect_threshold swinging_door_segments describe_event composite_events class_losses timing_losses
paired_reduction match_greedy select_threshold spatial_gradient_direction network_prior_topk read_scada_csv privacy_scan tail_cdf_match stream_regularize
stream_online_doors rows_by_refit_snapshots block_weights auroc_ties""".split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("RAMPLAKE_ALL") else CORE)
def test_query(spark, con, name):
    verdict, _, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert verdict in ("ok", "rows"), verdict


SMALL = """gap_fill_linear gap_guarded_diff rolling_mean_std ramp_abs_rolling valid_runs history_vector target_path horizon_targets sample_index resample_interpolate
run_length_flags daily_persistence detect_financial_tail detect_mean_shift composite_events swinging_door_segments detect_endpoint_corridor calendar_grid_join""".split()


@pytest.mark.parametrize("name", SMALL)
def test_query_across_chunks(spark, con, tiny_chunks, name):
    """The same rows when each series is cut into many chunks."""
    verdict, _, _ = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert verdict == "ok", verdict


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
