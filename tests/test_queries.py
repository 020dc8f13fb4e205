"""Every registered query against its SQL, plain and with all keys treated as hot."""

import os

import pytest

import oracle
from tickwise.operators.ordered import HOT_ROWS_CONF
from tickwise.queries import ORACLES, QUERIES, load_all

load_all()
SF = os.path.join(oracle.TESTDATA, "sf0.001")
STREAMS = {n for n in QUERIES if n.startswith("stream_")}
# Queries whose operators take hot keys apart.
SPLITTING = sorted(
    set("""time_chunks episode_file_offset heldout_anti cap_per_dataset topk_scores interleave mixup hold_resample
    hold_chunked_equal ffill_bfill finite_difference linear_interp_trace fractional_resample jump_segment
    label_bool_topic label_metadata label_terminal label_dispatch sliding_windows windows_by_split bag_tail_filter
    pad_bags pool_gated_attention pool_attention pool_max pool_mean split_stratified split_zeroshot
    split_pools_proportional weighted_resample fit_scaler fit_scaler_sumsq threshold_f1 auc roc_curve
    metrics_per_dataset prefix_bag_trace tail_bag_trace trace_metrics rank_failures rank_successes
    two_pass_selection aligned_summary""".split())
)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", SPLITTING)
def test_matches_sql_when_every_key_is_hot(spark, con, name):
    spark.conf.set(HOT_ROWS_CONF, "5")
    try:
        assert oracle.compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


def test_every_operator_is_registered():
    assert set(QUERIES) == set(ORACLES)
    # 111 operators, the flagship and the late samples of the hold stream.
    assert len(QUERIES) == 113
    assert len(STREAMS) == 6
