"""Mixing: shares reached, caps kept, soft members, and the classifier on held-out documents."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilery.llm import mixing as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no tokenizer")
TOPICS = {"a": "apple pear plum fig".split(), "b": "iron zinc lead tin".split(), "c": "wolf bear lynx hare".split()}


def documents(spark, counts, unlisted=0, seed=1):
    random.seed(seed)
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((i, " ".join(random.choices(TOPICS[source], k=20)), f" {source.upper()} "))
            i += 1
    for _ in range(unlisted):
        rows.append((i, " ".join(random.choices(TOPICS[random.choice("abc")], k=20)), random.choice([None, "", "other"])))
        i += 1
    return spark.createDataFrame(rows, "id long, text string, source string")


def test_shares_and_shortfall(spark):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 4), ("c", 0.1, 1), ("gone", 0.1, 3)], "source string, weight double, max_repeats int")
    mix = M.mix_sources(documents(spark, {"a": 300, "b": 100, "c": 200}), targets, "id", "text", "source", soft=False)
    report = {r["source"]: r for r in mix.report.collect()}
    assert {k for k, r in report.items() if r["short"]} == {"gone"}
    assert report["a"]["expected"] == pytest.approx(report["a"]["target"], rel=1e-3)
    rows = mix.documents.select("source", "rate", "copies").collect()
    caps = {"A": 1, "B": 4, "C": 1}
    assert all(0 <= r["rate"] <= caps[r["source"].strip()] and r["rate"] - 1 < r["copies"] < r["rate"] + 1 and r["copies"] <= caps[r["source"].strip()] for r in rows)
    shares = {r["source"]: r for r in M.reached_shares(mix).collect()}
    assert shares["b"]["reached"] == pytest.approx(report["b"]["target"], rel=0.15)
    assert sum(r["reached_share"] for r in shares.values()) == pytest.approx(1)


def test_cap_leaves_short(spark):
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.8, 2)], "source string, weight double, max_repeats int")
    mix = M.mix_sources(documents(spark, {"a": 90, "b": 10}), targets, "id", "text", "source", soft=False)
    report = {r["source"]: r for r in mix.report.collect()}
    assert report["b"]["short"] and not report["a"]["short"]
    assert report["b"]["expected"] == pytest.approx(2 * report["b"]["available"], rel=1e-6)


def test_soft_members_fill_in(spark):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 1), ("c", 0.3, 1)], "source string, weight double, max_repeats int")
    frame = documents(spark, {"a": 100, "b": 10, "c": 90}, unlisted=150)
    mix = M.mix_sources(frame, targets, "id", "text", "source")
    report = {r["source"]: r for r in mix.report.collect()}
    assert report["b"]["expected"] > 1.5 * report["b"]["available"]
    hard = M.mix_sources(frame, targets, "id", "text", "source", soft=False)
    assert {r["source"] for r in hard.report.where("short").collect()} == {"b"}


def test_classifier_held_out(spark):
    train = documents(spark, {"a": 60, "b": 60, "c": 60}, seed=2)
    test = documents(spark, {"a": 40, "b": 40, "c": 40}, seed=3)
    code, ids = "int(ascii(trim(lower(source))) - 97)", M.tokenised(spark)(F.col("text"), F.lit(True))["ids"].alias("ids")
    model = M.fit_classifier(train.select(F.expr(code).alias("label"), ids), "label", "ids", 3)
    rows = test.select(F.expr(code).alias("label"), ids).select("label", model.posterior()("ids").alias("p")).collect()
    assert np.mean([int(np.argmax(r["p"])) == r["label"] for r in rows]) >= 0.95
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
    assert model.tried > 20 and model.accuracy >= 0.95 and model.loss < 0.3 * model.prior_loss


def test_texts_that_tell_nothing_get_the_prior(spark):
    random.seed(5)
    rows = [(i, " ".join(random.choices("apple iron wolf pear zinc lynx".split(), k=30)), "aab"[i % 3]) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, text string, source string").select((F.col("source") == "b").cast("int").alias("label"), M.tokenised(spark)("text", F.lit(True))["ids"].alias("ids"))
    model = M.fit_classifier(frame, "label", "ids", 2)
    assert model.loss <= model.prior_loss and model.evidence <= 3
    assert frame.select(model.posterior()("ids").alias("p")).first()["p"][1] == pytest.approx(1 / 3, abs=0.08)


def test_a_domain_hardly_anything_belongs_to(spark):
    """Its target can't be reached; the others are, and are not given up for it."""
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("gone", 0.4, 3)], "source string, weight double, max_repeats int")
    mix = M.mix_sources(documents(spark, {"a": 300, "b": 100}, unlisted=20), targets, "id", "text", "source")
    assert {r["source"] for r in mix.report.where("short").collect()} == {"gone"}


def test_tokens(spark):
    rows = [("apple pear", True), ("apple pear", False), (None, True), ("", True), ("é" * 50_000, False)]
    frame = spark.createDataFrame(rows, "text string, keep boolean")
    got = [r[0] for r in frame.coalesce(1).select(M.tokenised(spark)("text", "keep")).collect()]
    assert got[0]["tokens"] == got[1]["tokens"] == len(got[0]["ids"]) >= 2 and got[1]["ids"] is None
    assert got[2] == got[3] == (0, []) and got[4]["tokens"] > 1000


def test_error_falls_in_every_round():
    rng = np.random.default_rng(0)
    p, caps, tokens = rng.dirichlet(np.ones(4), 200), np.array([1.0, 2, 3, 1]), rng.integers(1, 100, 200).astype(float)
    goal, capacity = tokens.sum() * np.array([0.4, 0.1, 0.3, 0.2]), tokens @ p
    steps, errors = [], []
    for _ in range(30):
        now = (M._rates(p, caps, steps) * tokens) @ p
        errors.append((((now - goal) ** 2) / np.maximum(capacity, goal / 20)).sum())
        steps.append((now - goal) / np.maximum(capacity, goal / 20))
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:])) and errors[-1] < errors[0]


def test_odd_rows(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    frame = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x" * 200_000, " A"), (3, "pear", "a"), (None, "pear", None)], "id long, text string, source string")
    frame = frame.selectExpr("*", "1 AS tokens", "2 AS rate", "'k' AS label")
    mix = M.mix_sources(frame, targets, "id", "text", "source")
    assert mix.documents.count() == 5 and mix.report.count() == 1
    empty = M.mix_sources(frame.limit(0), targets, "id", "text", "source")
    assert empty.report.first()["expected"] == 0 and empty.documents.count() == 0
    none = M.mix_sources(frame, targets.limit(0), "id", "text", "source", soft=False)
    assert none.report.count() == 0 and M.mix_sources(frame, targets.limit(0), "id", "text", "source").report.count() == 0


def test_odd_targets(spark):
    rows = [("a", 0.25, 1), (" A ", 0.25, 3), ("b", 0.5, 2), (None, 0.5, 1), ("", 0.5, 1), ("c", None, None)]
    targets = spark.createDataFrame(rows, "source string, weight double, max_repeats int")
    mix = M.mix_sources(documents(spark, {"a": 30, "b": 30, "c": 30}), targets, "id", "text", "source", soft=False)
    report = {r["source"]: (r["weight"], r["max_repeats"]) for r in mix.report.collect()}
    assert report == {"a": (0.5, 3), "b": (0.5, 2), "c": (0.0, 0)}


def test_one_way_or_another(spark):
    """Rates and copies from the checkpoint are those of the documents themselves."""
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.3, 2)], "source string, weight double, max_repeats int")
    mix = M.mix_sources(documents(spark, {"a": 40, "b": 20, "c": 30}, unlisted=25), targets, "id", "text", "source")
    listed = F.trim(F.lower("source"))
    own = mix.documents.select(F.when(listed.isin("a", "b", "c"), listed).alias("source"), "rate", "copies")
    rows = lambda f: sorted((r["source"] or "", round(r["rate"], 9), r["copies"]) for r in f.collect())
    assert rows(mix.sizes) == rows(own) and mix.documents.columns == ["id", "text", "source", "rate", "copies"]
    report = {r["source"]: r for r in mix.report.collect()}
    # what the fit expects is what the rates give, declared and soft members together
    total = mix.sizes.agg(F.sum(F.col("rate") * F.col("tokens"))).first()[0]
    assert total == pytest.approx(sum(r["expected"] for r in report.values()))
    assert {k: r["short"] for k, r in report.items()} == {"a": True, "b": False, "c": False}
    assert all(report[x]["expected"] == pytest.approx(report[x]["target"], rel=1e-3) for x in "bc")


def test_unsettled_rates_raise(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, weight double, max_repeats int")
    with pytest.raises(RuntimeError, match="did not settle"):
        M.mix_sources(documents(spark, {"a": 9, "b": 3}), targets, "id", "text", "source", rounds=1)


def test_copies_are_sampled_one_by_one(spark, monkeypatch):
    met = {}
    fit = M.fit_classifier
    monkeypatch.setattr(M, "fit_classifier", lambda *a, **k: met.setdefault("model", fit(*a, **k)))
    copies = spark.createDataFrame([(i, "apple pear plum", "a") for i in range(1000)] + [(1000 + i, f"iron{i} zinc", "b") for i in range(1000)], "id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, weight double, max_repeats int")
    M.mix_sources(copies, targets, "id", "text", "source", rows=200)
    assert np.exp(met["model"].priors)[0] == pytest.approx(0.5, abs=0.15)
