"""Relevance suites: evaluation of test cases and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate(tests: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """tests with `observed` and `passed`: the observed text must be the expected one, blanks apart. A case without an
    observation fails."""
    plain = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    joined = tests.join(observed, key, "left")
    return joined.withColumn("passed", F.coalesce(plain(F.col("observed")) == plain(F.col("expected")), F.lit(False)))


def passes_any(tests: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """(key, passed): whether some path of the case, a row (key, path_text), reads as expected."""
    return tests.join(paths, key, "left").groupBy(key).agg(F.coalesce(F.max(F.col("path_text") == F.col("expected")), F.lit(False)).alias("passed"))


def latest_results(results: DataFrame) -> DataFrame:
    """One row a result_id: the one received last."""
    row = F.struct("case_id", "collection_id", "build", "passed", "n_tokens", "elapsed_ms", "ran_at", "received_at")
    return results.groupBy("result_id").agg(F.max_by(row, F.struct("received_at", "passed", "elapsed_ms")).alias("r")).select("result_id", "r.*")


def tally(results: DataFrame, *by: str | Column) -> DataFrame:
    """(by, passed, total) of results with a verdict."""
    judged = results.where(F.col("passed").isNotNull())
    return judged.groupBy(*by).agg(F.sum(F.col("passed").cast("bigint")).alias("n_passed"), F.count("*").alias("n_run"))


def by_suite(results: DataFrame, suites: DataFrame, key: str) -> DataFrame:
    """(suite, n_passed, n_run): a result counts in every suite (key, suite) of its case, once.

    Results are counted by case first, so the rows that meet their suites are one a case."""
    own = suites.select(key, "suite").distinct()
    return tally(results, key).join(own, key).groupBy("suite").agg(F.sum("n_passed").alias("n_passed"), F.sum("n_run").alias("n_run"))


def failing(evaluated: DataFrame, show_passed: bool = False) -> DataFrame:
    return evaluated if show_passed else evaluated.where(~F.col("passed"))


def rebase(evaluated: DataFrame) -> DataFrame:
    """(priority, suites, input, expected): the cases with what was observed as the new expectation."""
    return evaluated.select("priority", "suites", "input", F.col("observed").alias("expected"))


def report(failures: DataFrame, suites: DataFrame, priorities: DataFrame, overall: DataFrame) -> DataFrame:
    """(section, name, line) of a printed report: failing cases (name, input, expected, observed), and the tallies
    (n_passed, n_run) by suite, by priority and overall. In the order of section and name it reads from top to bottom."""

    def shares(tallied: DataFrame, section: str, name: Column) -> DataFrame:
        line = F.concat(name, F.lit(": "), F.col("n_passed").cast("string"), F.lit("/"), F.col("n_run").cast("string"))
        return tallied.select(F.lit(section).alias("section"), name.alias("name"), line.alias("line"))

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    case = F.concat(text("name"), F.lit(" FAILED\n   input: "), text("input"), F.lit("\nexpected: "), text("expected"), F.lit("\nobserved: "), text("observed"))
    rows = failures.select(F.lit("1 cases").alias("section"), text("name").alias("name"), case.alias("line"))
    for tallied, section, name in ((suites, "2 suites", text("suite")), (priorities, "3 priorities", text("priority")), (overall, "4 overall", F.lit("overall"))):
        rows = rows.unionByName(shares(tallied, section, name))
    return rows


def print_report(rows: DataFrame, write=print) -> None:
    """Writes a report line by line, one partition of rows at a time."""
    for row in rows.orderBy("section", "name", "line").toLocalIterator():
        write(row["line"])
