"""The set join against all pairs."""

import random
from fractions import Fraction
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilery.llm import setjoin as S

SHARE = Fraction(3, 5)


def brute(records, least=3):
    sets = {k: {x for x in v or () if x} for k, v in records if k is not None}
    sets = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=15, unique=True).map(sorted), max_size=9), st.integers(1, 5), st.integers(0, 41))
def test_merge_skip(lists, wanted, below):
    want = [x for x in range(below) if sum(x in own for own in lists) >= wanted]
    assert S.merge_skip(lists, wanted, below) == want


def make(n, vocabulary, seed, copies=0):
    random.seed(seed)
    rows = [[random.choice(vocabulary) for _ in range(random.randint(0, 8))] for _ in range(n)]
    for i in range(n // 3):
        own = list(rows[i])
        if own and random.random() < 0.7:
            own[random.randrange(len(own))] = random.choice(vocabulary)
        rows.append(own)
    rows += [["x", "y", "z"]] * copies
    rows += [None, [], [None, ""], ["a", "a", "a"]]
    return list(enumerate(rows))


@pytest.mark.parametrize("vocabulary, block, buckets", [(200, 1500, 1 << 20), (12, 1500, 1 << 20), (12, 5, 1 << 20), (12, 5, 3), (40, 3, 1)])
def test_pairs(spark, vocabulary, block, buckets):
    records = make(150, [f"w{i}" for i in range(vocabulary)], vocabulary, copies=6)
    frame = spark.createDataFrame([(k, v, "c") for k, v in records], "class_id long, tokens array<string>, key string")
    classes = S.set_classes(frame, "class_id", "tokens", 3)
    distinct = classes.groupBy("class_id").agg({"tokens": "first", "key": "collect_list"}).toDF("class_id", "tokens", "keys").cache()
    keys = {bytes(r["class_id"]): r["keys"] for r in distinct.collect()}
    links = S.similar_classes(distinct.select("class_id", "tokens"), SHARE, block, buckets).collect()
    links = [(bytes(r["class_a"]), bytes(r["class_b"])) for r in links]
    assert len(set(links)) == len(links), "each pair once"
    got = {tuple(sorted((a, b))) for x, y in links for a in keys[x] for b in keys[y]}
    got |= {p for own in keys.values() for p in combinations(sorted(own), 2)}
    assert got == brute(records)


def test_grades():
    assert [S.grade(n) for n in (0, 1, 2, 3)] == [0, 0, 9, 13]
    assert all(S.grade(n) <= S.grade(n + 1) for n in range(5000)) and S.grade(1 << 60) == 255


def test_grades_of_tokens(spark):
    frame = spark.createDataFrame([([1, 2, -3],), ([1, 2],), ([1],), ([],)], "tokens array<long>")
    got = S.token_grades(frame, 5)
    assert got.tolist() == [0, S.grade(3), S.grade(3), 0, 0]


@pytest.mark.parametrize("split, sent", [(10_000, 100_000), (1, 100_000), (2, 0)])
def test_pair_rows_and_counts(spark, monkeypatch, split, sent):
    monkeypatch.setattr(S, "BROADCAST_ROWS", sent)
    records = make(80, [f"w{i}" for i in range(10)], 5, copies=4)
    frame = spark.createDataFrame(records, "id long, words array<string>")
    rows = [tuple(r) for r in S.similar_pairs(frame, "id", "words", SHARE, 3, split).collect()]
    want = brute(records)
    assert set(rows) == want and len(rows) == len(want)
    sets = {k: frozenset(x for x in v if x) for k, v in records if v}
    for r in S.similar_counts(frame, "id", "words", SHARE, 3).collect():
        assert r["class_id"] == min(k for k in sets if sets[k] == sets[r["id"]])
    links = {r["id"]: r["links"] for r in S.similar_counts(frame, "id", "words", SHARE, 3).collect()}
    for k, n in links.items():
        assert n == sum(k in p for p in want)
    assert sum(links.values()) == 2 * len(want)


def test_empty(spark):
    frame = spark.createDataFrame([], "id long, words array<string>")
    assert S.similar_pairs(frame, "id", "words", SHARE, 3).count() == 0
    assert S.similar_counts(frame, "id", "words", SHARE, 3).count() == 0
