"""Every registered query of the core against its SQL, at the smallest scale."""

import os

import pytest

from tilery.plans import engine_queries, graph_queries, packed_queries, text_queries

SF = "/root/testdata/sf0.001"
MODULES = (engine_queries, packed_queries, text_queries, graph_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, name, query, sql):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    frame = query(spark, SF)
    want = connection.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(names, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLE[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_forms_agree(spark):
    local, relational = (sorted(map(tuple, QUERIES[name](spark, SF).collect())) for name in ("utterance_tokens", "utterance_tokens_relational"))
    assert local == relational and local


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_order_inputs_are_understood(spark):
    counts = QUERIES["utterance_relevance"](spark, SF).collect()
    assert sum(r["n_passed"] for r in counts) >= 0.6 * sum(r["n_run"] for r in counts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_cases_without_an_expectation_count(spark):
    cases = spark.read.parquet(f"{SF}/test_cases.parquet").where("kind = 'order' AND trim(input) <> ''")
    assert cases.where("expected IS NULL OR trim(expected) = ''").count() > 0
    for name in ("utterance_relevance", "utterance_relevance_any"):
        assert sum(r["n_run"] for r in QUERIES[name](spark, SF).collect()) == cases.count()
    based = QUERIES["relevance_rebase"](spark, SF)
    assert based.count() == cases.count() and based.where("expected IS NULL").count() == 0


def test_speech_of_every_input(spark, tmp_path):
    cases = {
        ("order", "Okay, 2 teas & 1/2 a pie!"): "ok two teas and half a pie",
        ("order", "two (small) teas"): "two small teas",
        ("lookup", "size 42 boots"): "size forty two boots",
        ("lookup", "1/4 bolt, 10%"): "quarter bolt ten percent",
        (None, "‘x’"): "'x'",
        ("lookup", "the “big” one"): "the big one",
        ("lookup", ""): "",
        ("lookup", None): None,
    }
    rows = [(i, kind, text) for i, (kind, text) in enumerate(cases)]
    spark.createDataFrame(rows, "case_id long, kind string, input string").write.parquet(f"{tmp_path}/test_cases.parquet")
    got = {r["case_id"]: r["said"] for r in QUERIES["speech_filter"](spark, str(tmp_path)).collect()}
    assert got == {i: said for i, said in enumerate(cases.values()) if said is not None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_speech_leaves_no_input_out(spark):
    inputs = spark.read.parquet(f"{SF}/test_cases.parquet").where("input IS NOT NULL")
    said = QUERIES["speech_filter"](spark, SF)
    assert said.count() == inputs.count() and said.where(r"said IS NULL OR said RLIKE '(^| )[0-9]+( |$)'").count() == 0
