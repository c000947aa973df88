"""Registered queries of the subpackage against their SQL, and the whole tables against brute force."""

import os

import pytest

from tests.test_queries import SF, compare
from tilery.llm import queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_lookup_is_answered_once(spark):
    cases = spark.read.parquet(f"{SF}/test_cases.parquet").where("kind = 'lookup' AND trim(input) <> ''")
    got = queries.p1_found(spark, SF)
    assert got.count() == cases.count() and got.select("case_id").distinct().count() == cases.count()
