"""Registered queries against their oracle SQL. METEOQC_ALL=1 runs every one of them."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry

QUICK = """departures_from_recent_mean lag_features elapsed_and_rate_features unchanged_run_features missing_value_runs station_dimension
nearest_neighbour_edges bucketed_neighbour_features causal_neighbour_matches spatial_context_category archive_csv_observations
generic_csv_observations provider_json_observations qualification_gate variable_profile cadence_profile arrival_status
decision_cascade station_health imputed_readings resampled_grid augmentation_labels event_detections anomaly_episodes
scenario_transforms explanation_texts source_states outage_episodes stream_arrival_status csv_files_with_mixed_headers
json_lines_payload_counts readings_stored_once retention_run decision_cascade_of_repeated_feed radius_sweep stream_half_hour_windows""".split()

SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("METEOQC_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, con, name):
    _, problems = compare(name, entry.queries()[name](spark, sf), con, SQL[name])
    assert not problems


def test_oracles_have_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
