"""Registered queries against their SQL at sf0.001: a sample over all subjects, or every one with WEEKWATCH_ALL=1."""

import os

import oracle
import pytest
from conftest import SF

import __spark_entry__ as entry
from weekwatch.plans.registry import ORACLES, QUERIES

SAMPLE = [
    "top_places_latest_week", "dense_grid", "dense_grid_whole_years", "rates_by_window", "total_of_kinds", "alert_thresholds", "momentum_features",
    "episodes", "onset_targets", "alert_anticipation", "false_alert_runs", "priority_backtest", "best_rank_before_episode", "episode_master",
    "observed_priority", "nearest_station", "station_weather_block", "cell_weather_block", "trailing_daily_rain", "climate_fact", "lag_correlations",
    "strongest_lag", "ranking_metrics", "feature_drift", "population_series", "forecast_backtest", "year_projection", "place_measures", "gate_findings",
    "freshness", "mask_sensitive_text", "notification_routing", "newest_success_per_resource", "region_by_year_pivot", "future_years",
    "streamed_daily_readings", "streamed_weekly_counts", "streamed_latest_readings",
]


def names():
    return sorted(ORACLES) if os.environ.get("WEEKWATCH_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, con, name):
    problems, *_ = oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert not problems, problems


def test_registry_is_consistent(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert set(QUERIES) <= set(q)
    assert entry.entry(spark).count() >= 0
