"""Queries that leave no row of their table out."""

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meteoqc.plans import model_plans
from meteoqc.schema import KEY, TS


def test_every_reading_is_attributed(obs):
    found = model_plans.attributions(obs).groupBy(KEY, TS).agg(F.first("flagged").alias("flagged"), F.first("score").alias("score")).collect()
    assert len(found) == obs.select(KEY, TS).distinct().count()
    assert all(r.flagged == (r.score >= 0.5) for r in found) and {r.flagged for r in found} == {True, False}


@pytest.mark.parametrize("name", ["error_categories_of_all_rows", "absent_rows_of_all_inserted"])
def test_whole_table_matches_oracle(spark, sf, obs, name):
    n, problems = compare(name, entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name])
    assert not problems and n == obs.count()
