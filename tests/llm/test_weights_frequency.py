"""Log-entropy weights and term counts against plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tilery.functions.text import alias_forms, item_terms, name_form
from tilery.llm.frequency import mark_terms, sum_ranges, term_frequency
from tilery.llm.weights import log_entropy

RECORDS = {1: ["a", "a", "b"], 2: ["a", "c"], 3: ["a", "b", "b"], 4: [], 5: ["d"]}


def brute(records):
    tf = {(k, t): n for k, terms in records.items() for t, n in Counter(terms).items()}
    spread = defaultdict(list)
    for (_, t), n in tf.items():
        spread[t].append(n)
    out = {}
    for (k, t), n in tf.items():
        total = sum(spread[t])
        entropy = -sum(x / total * math.log(x / total) for x in spread[t])
        out[k, t] = (n, len(spread[t]), math.log(1 + n) * (1 - entropy / math.log(max(len(records), 2))))
    return out


def test_weights(spark):
    frame = spark.createDataFrame([(k, t, "x") for k, t in RECORDS.items()], "term long, words array<string>, tf string")
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in log_entropy(frame, "term", "words").toDF("k", "t", "tf", "n", "w").collect()}
    want = brute(RECORDS)
    assert got.keys() == want.keys()
    for k, (n, held, weight) in want.items():
        assert got[k][:2] == (n, held) and got[k][2] == pytest.approx(weight)


def test_weights_limits_and_hot_terms(spark):
    records = {i: ["all", f"t{i % 700}"] for i in range(2100)}
    frame = spark.createDataFrame(list(records.items()), "k long, words array<string>")
    want = brute(records)
    got = {(r["k"], r["term"]): r["weight"] for r in log_entropy(frame, "k", "words").collect()}
    assert got.keys() == want.keys() and got[5, "all"] == pytest.approx(want[5, "all"][2], abs=1e-9) and got[5, "t5"] == pytest.approx(want[5, "t5"][2])
    few = {(r["k"], r["term"]) for r in log_entropy(frame, "k", "words", min_records=2, max_records=6).collect()}
    assert few == {k for k, (_, held, _) in want.items() if 2 <= held <= 6}


def test_weights_odd_rows(spark):
    schema = "k long, words array<string>"
    assert log_entropy(spark.createDataFrame([], schema), "k", "words").count() == 0
    frame = spark.createDataFrame([(1, None), (None, ["x", None]), (None, ["x"])], schema)
    assert [(r["k"], r["term"], r["tf"], r["records"]) for r in log_entropy(frame, "k", "words").collect()] == [(None, "x", 2, 1)]


def test_normal_forms(spark):
    rows = [("Ｒosé  &  Co", [" Exact : The-Usual", None, "", "é́x", "prefix:prefix:a"]), (None, None)]
    frame = spark.createDataFrame(rows, "name string, aliases array<string>")
    got = frame.select(name_form("name").alias("n"), alias_forms("aliases").alias("a"), item_terms("name", "aliases").alias("t")).collect()
    assert got[0]["n"] == "rosé co" and got[0]["a"][:3] == ["the usual", None, ""] and got[0]["a"][4] == "prefix a"
    assert got[0]["t"][:4] == ["rosé", "co", "the", "usual"]
    assert (got[1]["n"], got[1]["a"], got[1]["t"]) == (None, [], [])


def test_counts(spark):
    rows = [("f", ["Exact:a b", "a"]), ("f", ["b-b", None, ""]), ("f", None), ("g", ["exact:a"]), ("h", ["z"])] * 3
    frame = spark.createDataFrame(rows, "field string, texts array<string>").repartition(5)
    counts = term_frequency(frame, {"f": True, "g": False})
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in counts.collect()}
    assert got == {("f", "a"): (6, 3), ("f", "b"): (9, 6), ("g", "exact"): (3, 3), ("g", "a"): (3, 3)}
    # one identifier a term, dense and in the order of the terms
    assert {(r["term"], r["term_id"]) for r in counts.collect()} == {("a", 0), ("b", 1), ("exact", 2)}
    totals = frame.groupBy("field").agg(F.count("*").alias("n_records"))
    marks = {(r["field"], r["term"]): r["mark"] for r in mark_terms(counts, totals, rare=3, common_share=0.5).collect()}
    assert marks == {("f", "a"): "rare", ("f", "b"): "common", ("g", "exact"): "rare", ("g", "a"): "rare"}


def test_counts_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.range(500).select(F.lit("f").alias("field"), F.array(F.concat(F.lit("w"), F.col("id") % 13), F.lit("all")).alias("texts"))
        got = {r["term"]: (r["occurrences"], r["records"]) for r in term_frequency(frame, {"f": False}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter(f"w{i % 13}" for i in range(500)) | Counter({"all": 500})
    assert got == {k: (v, v) for k, v in want.items()}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_sums_by_range(spark, width):
    rows = [(i % 2, (i * 7) % 50, i, 1) for i in range(400)]
    frame = spark.createDataFrame(rows, "field int, term_id long, occurrences long, records long").where("occurrences > 0").repartition(5)
    want = defaultdict(lambda: [0, 0])
    for f, t, o, r in rows[1:]:
        want["xy"[f], t][0] += o
        want["xy"[f], t][1] += r
    got = {(r[0], r[1]): [r[2], r[3]] for r in sum_ranges(frame, ["x", "y"], 50, width).collect()}
    assert got == dict(want)


def test_counts_empty(spark):
    assert term_frequency(spark.createDataFrame([], "field string, texts array<string>"), {"f": True}).count() == 0
