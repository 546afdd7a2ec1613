"""All registered queries and oracles, collected from the plan modules."""

from __future__ import annotations

import importlib

AREAS = ["feature_plans", "spatial_plans", "ingest_plans", "profile_plans", "decision_plans", "repair_plans", "evaluation_plans", "experiment_plans", "model_plans", "source_plans", "file_plans", "stream_plans", "keyed_stream_plans", "store_plans"]


def _modules():
    return [importlib.import_module(f"meteoqc.plans.{a}") for a in AREAS]


def queries():
    out = {}
    for m in _modules():
        clash = out.keys() & m.QUERIES.keys()
        assert not clash, clash
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
