"""Queries of the packed-field splitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilery.operators.packed import BRACKETED, SEPARATED, split_packed
from tilery.plans.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, field, pos, item_value): every value of every suites and expected cell."""
    return split_packed(table(spark, sf_dir, "test_cases"), "case_id", {"suites": SEPARATED, "expected": BRACKETED})


def p3_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, n_values, cells): how many cells hold how many values."""
    cells = p3_found(spark, sf_dir).groupBy("case_id", "field").agg((F.max("pos") + 1).alias("n_values"))
    return cells.groupBy("field", "n_values").agg(F.count("*").alias("cells"))


QUERIES = {"p3_found": p3_found, "p3_widths": p3_widths}

_VALUES = r"""
WITH cells AS (
  SELECT case_id, 'suites' AS field, list_transform(
    regexp_extract_all(suites, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”|[A-Za-z0-9_.\-][A-Za-z0-9_.\-'']*'),
    lambda v: CASE WHEN v[1] = '"' THEN replace(v[2:-2], '""', '"')
                   WHEN v[1] = '''' THEN replace(v[2:-2], '''''', '''')
                   WHEN v[1] = '“' THEN v[2:-2] ELSE v END) AS found
  FROM test_cases WHERE suites IS NOT NULL
  UNION ALL
  SELECT case_id, 'expected', list_transform(
    regexp_extract_all(expected, '\[(?:[^\]"]|"[^"]*")*\]|[A-Za-z0-9_:]+'),
    lambda v: CASE WHEN v[1] = '[' THEN v[2:-2] ELSE v END)
  FROM test_cases WHERE expected IS NOT NULL
), filled AS (SELECT case_id, field, list_filter(found, lambda v: v <> '') AS found FROM cells),
values_found AS (
  SELECT case_id, field, CAST(unnest(generate_series(0, len(found) - 1)) AS INTEGER) AS pos, unnest(found) AS item_value
  FROM filled WHERE len(found) > 0)
"""

ORACLE = {
    "p3_found": _VALUES + "SELECT case_id, field, pos, item_value FROM values_found",
    "p3_widths": _VALUES
    + "SELECT field, n_values, count(*) AS cells FROM (SELECT case_id, field, max(pos) + 1 AS n_values FROM values_found GROUP BY ALL) GROUP BY ALL",
}
