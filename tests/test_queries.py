"""Registered queries: the contract, a sample against DuckDB, and the shape of plans.

``TIDEMARK_FULL=1`` compares every query that has SQL.
"""

import os

import pytest
from check_oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SAMPLE = ["j11_forward_returns_hit_rate", "t12_signal_velocity", "t32_opportunity_streak", "a25_sell_trigger_effectiveness", "f01_signal_cascade", "c01_factors", "a24_threshold_sensitivity",
          "j03_k08_signal_changes", "s02_signal_log_json", "s04_x07_history_json", "r02_stream_change_alerts", "r04_stream_sessions", "t24_g10_drawdown_alerts", "x10_claim_extraction",
          "t20_j20_correlation_edges", "t22_effective_positions", "t25_portfolio_var", "j17_threshold_lookup", "p24_g37_position_size", "x09_headline_near_duplicates", "p54_g20_bayesian_posterior",
          "s08_s12_shard_merge"]
NAMES = sorted(oracle_sql()) if os.environ.get("TIDEMARK_FULL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, name):
    msg = compare(queries()[name](spark, sf).toPandas(), duck(sf).execute(oracle_sql()[name]).df())
    assert msg is None, msg


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["f01_signal_cascade", "t03_realised_vol", "j09_asof_price_backfill", "a01_a02_a05_scorecard", "t35_k07_post_mortem"])
def test_plans_stay_in_the_jvm_without_products(spark, sf, name):
    plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", ["a28_action_performance", "p54_g20_bayesian_posterior"])
def test_signals_are_reduced_by_hash(spark, sf, name):
    plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "max(struct" not in plan and "o_orderstatus), " not in plan


def test_scan_reads_only_needed_columns(spark, sf):
    plan = queries()["t03_realised_vol"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "l_comment" not in plan
