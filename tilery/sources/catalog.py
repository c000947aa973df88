"""Item, test and stop-word sources. YAML is read on the driver: catalogues are written by hand."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilery.schemas import ITEM, TEST_CASE


def _documents(text: str) -> Any:
    import yaml

    # every scalar as written: yes, no and numbers are not interpreted
    return yaml.load(text, Loader=yaml.BaseLoader)


def _wrong(what: str) -> TypeError:
    return TypeError(f"invalid document: {what}")


def _number(value: Any, what: str) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise _wrong(f"{what} must be a number") from None


def check_items(document: Any) -> list[dict]:
    """The items of a document {items: [{pid, name, aliases}]}; a TypeError says what is wrong. Further keys are allowed."""
    if not isinstance(document, dict) or not isinstance(document.get("items"), list):
        raise _wrong("items must be a list")
    for item in document["items"]:
        if not isinstance(item, dict):
            raise _wrong("an item must be an object")
        if not isinstance(item.get("name"), str):
            raise _wrong("name must be a string")
        if not isinstance(item.get("aliases"), list) or not all(isinstance(a, str) for a in item["aliases"]):
            raise _wrong("aliases must be a list of strings")
        _number(item.get("pid"), "pid")
    return document["items"]


def items_from_yaml(spark: SparkSession, text: str, domain: str) -> DataFrame:
    """Items of a YAML text, duplicates resolved."""
    rows = [(domain, i, int(float(x["pid"])), x["name"], x["aliases"]) for i, x in enumerate(check_items(_documents(text)))]
    return last_wins(spark.createDataFrame(rows, ITEM))


def last_wins(items: DataFrame) -> DataFrame:
    """One row a (domain, pid): the last row's name and aliases at the first row's place."""
    last = F.max_by(F.struct("name", "aliases"), "ord")
    return items.groupBy("domain", "pid").agg(F.min("ord").alias("ord"), last.alias("last")).select("domain", "ord", "pid", "last.*")


def check_tests(document: Any) -> list[dict]:
    """The cases of a document [{priority, suites, input, expected}]; a TypeError says what is wrong."""
    if not isinstance(document, list):
        raise _wrong("tests must be a list")
    for case in document:
        if not isinstance(case, dict):
            raise _wrong("a test must be an object")
        if _number(case.get("priority"), "priority") % 1:
            raise _wrong("priority must be an integer")
        for name in ("suites", "input", "expected"):
            if not isinstance(case.get(name), str):
                raise _wrong(f"{name} must be a string")
    return document


def tests_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    rows = [(i, str(int(float(x["priority"]))), x["suites"].split(), x["input"], x["expected"]) for i, x in enumerate(check_tests(_documents(text)))]
    return spark.createDataFrame(rows, TEST_CASE)


def items_from_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Items of one YAML file per domain."""
    out = None
    for domain, path in paths.items():
        text = spark.read.text(path, wholetext=True).first()[0]
        own = items_from_yaml(spark, text, domain)
        out = own if out is None else out.unionByName(own)
    return out


def _problems(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(wrong, F.lit(what)) for what, wrong in checks.items()]))
    return rows.select(key, F.explode(found).alias("problem"))


def invalid_items(items: DataFrame, key: str) -> DataFrame:
    """(key, problem): what is wrong with item rows (pid, name, aliases), by the rules of check_items; no row for a valid one."""
    holes = F.coalesce(F.exists("aliases", lambda a: a.isNull()), F.lit(True))
    checks = {"name must be a string": F.col("name").isNull(), "aliases must be a list of strings": holes, "pid must be a number": F.col("pid").isNull()}
    return _problems(items, key, checks)


def invalid_tests(tests: DataFrame, key: str) -> DataFrame:
    """(key, problem): what is wrong with rows of test cases, by the rules of check_tests; no row for a valid one."""
    checks = {"priority must be an integer": F.col("priority").isNull()}
    return _problems(tests, key, checks | {f"{c} must be a string": F.col(c).isNull() for c in ("suites", "input", "expected")})


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each line, trimmed; blank lines stay as empty texts."""
    return spark.read.text(path).select(F.trim("value").alias("text"))


def tests_to_yaml(cases: list[dict]) -> str:
    """YAML text of test cases, for a new baseline."""
    import yaml

    return yaml.safe_dump([{k: c[k] for k in ("priority", "suites", "input", "expected")} for c in cases], sort_keys=False, allow_unicode=True)


def stop_word_items(words: DataFrame, domain: str = "stop") -> DataFrame:
    """Stop words (text) as items of a domain, matched exactly; each word is an item of its own. To be left out of
    ingestion: they only lend their terms. Blank texts are no items."""
    rows = words.where(F.col("text") != "").distinct()
    expression = F.array(F.concat(F.lit("exact:"), F.col("text")))
    return rows.select(F.lit(domain).alias("domain"), F.lit(0).alias("ord"), F.crc32("text").alias("pid"), F.col("text").alias("name"), expression.alias("aliases"))
