"""Mapping of typed values: errors that must be seen through, and neighbours that must not be confused."""

import math
import random

import pytest

from pyspark.sql import functions as F

from tilery.llm.mapping import features, map_values, plain, plain_form, retrieve

NAMES = [f"{c} {m} Bicycle" for c in ("Crimson", "Turquoise", "Charcoal") for m in ("Commuter", "Mountain", "Folding")]
NAMES += ["Stainless Saddle", "Rubber Bottle", "Waterproof Saddle", "Rubber Odometer", "Leather Speedometer", "Safety Inspection"]
NAMES.remove("Crimson Mountain Bicycle")

SEEN = {
    "crimson commuter bicycle": "Crimson Commuter Bicycle", "CRIMSON COMMUTER!!": "Crimson Commuter Bicycle", "crimsoncommuter bike": "Crimson Commuter Bicycle",
    "c rimson comuter byke": "Crimson Commuter Bicycle", "commuter in crimson": "Crimson Commuter Bicycle", "bike , folding turquoise please": "Turquoise Folding Bicycle",
    "trqs folding": "Turquoise Folding Bicycle", "chrcl cmmtr bike": "Charcoal Commuter Bicycle", "stainl. saddle": "Stainless Saddle", "ruber botle (new)": "Rubber Bottle",
    "ｓafety ínspection": "Safety Inspection", "crimson mountain bike": None, "waterproof bottle": None,
    "crimson piano": None, "saddle": None, "zvwy ckbw": None, "where is my order": None, "rubber": None, "?": None,
}


@pytest.fixture(scope="module")
def mapped(spark):
    values = [(i, v, "x") for i, v in enumerate(SEEN)] + [(1000, None, "x"), (1001, "  ", "x"), (0, next(iter(SEEN)), "x")]
    frame = spark.createDataFrame(values, "id long, value string, entry string")
    entries = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)] + [(99, None)], "pid long, name string")
    return map_values(frame, "id", "value", entries, "pid", "name", cover=0.25).collect()


def test_values(mapped):
    got = {r["id"]: NAMES[r["pid"]] if r["pid"] >= 0 else None for r in mapped}
    for i, (value, want) in enumerate(SEEN.items()):
        assert got[i] == want, value
    assert not {1000, 1001} & got.keys()
    assert sum(r["id"] == 0 for r in mapped) == 2


def test_generated_errors(spark):
    random.seed(7)
    rows = []
    for i in range(300):
        name = random.randrange(len(NAMES))
        words = NAMES[name].lower().split()
        at = random.randrange(2)
        word = words[at]
        k = random.randrange(1, len(word) - 1)
        words[at] = random.choice([word[:k] + word[k + 1 :], word[:k] + "x" + word[k:], word[:k] + "x" + word[k + 1 :], word[: k - 1] + word[k] + word[k - 1] + word[k + 1 :]])
        if random.random() < 0.3:
            words = [words[1], words[0], *words[2:]]
        rows.append((i, " ".join(words), name))
    frame = spark.createDataFrame(rows, "id long, value string, want long")
    entries = spark.createDataFrame(list(enumerate(NAMES)), "pid long, name string")
    got = {r["id"]: r["pid"] for r in map_values(frame, "id", "value", entries, "pid", "name").collect()}
    right = sum(got[i] == want for i, _, want in rows)
    wrong = sum(got[i] not in (want, -1) for i, _, want in rows)
    assert right >= 0.98 * len(rows) and wrong == 0


CITIES = ("New York City", "Saint Petersburg", "San Francisco", "San Jose", "São Paulo", "Los Angeles", "Las Vegas", "New Orleans", "Salt Lake City", "Santa Fe", "München", "Zürich")
JOBS = ("Software Engineer", "Data Engineer", "Data Scientist", "Product Manager", "Project Manager", "Sales Manager", "Accountant", "Registered Nurse", "Mechanical Engineer")


@pytest.mark.parametrize(
    ("entries", "seen"),
    [
        (CITIES, {"st petersburg": 1, "St. Petersburgh": 1, "san francisco ca usa": 2, "San Fransisco": 2, "sao paulo": 4, "Sao  Paolo": 4, "los angelos": 5,
                  "LAS VEGAS, NV": 6, "muenchen": 10, "zurich (CH)": 11, "new york": 0, "london": -1, "": None}),
        (JOBS, {"sr software engineer ii": 0, "Softwear Engineer": 0, "data scientst": 2, "data engneer": 1, "Prod. Manager": 3, "accountnt": 6, "nurse, registered": 7,
                "mech engineer": 8, "astronaut": -1}),
    ],
)
def test_cities_and_jobs(spark, entries, seen):
    values = spark.createDataFrame(list(seen.items()), "value string, want long")
    values = values.withColumn("id", F.col("value"))
    got = {r["id"]: r["pid"] for r in map_values(values, "id", "value", spark.createDataFrame(list(enumerate(entries)), "pid long, name string"), "pid", "name").collect()}
    assert got == {k: v for k, v in seen.items() if v is not None}


@pytest.mark.parametrize("least", [0.05, 0.24, 0.6])
def test_all_pairs_of_the_cosine_are_found(spark, least):
    """Bounds on candidates lose nothing: brute force over all pairs, with many common features."""
    random.seed(3)
    kinds, tails = ("crimson", "turquoise", "charcoal", "rubber", "leather"), ("bicycle", "saddle bicycle", "bicycle handlebar", "bottle")
    names = sorted({f"{random.choice(kinds)} {random.choice(tails)}" for _ in range(40)})
    typed = sorted({f"{random.choice(kinds)[: random.randrange(3, 9)]} {random.choice(('bike ', 'bicycle ', ''))}{random.choice(tails)}" for _ in range(80)} | {"bicycle"})
    entries = spark.createDataFrame(list(enumerate(names)), "entry_id long, entry string")
    values = spark.createDataFrame(list(enumerate(typed)), "value_id long, value string")
    grams = {t: set(spark.range(1).select(features(F.lit(t))).first()[0]) for t in {*names, *typed}}
    held, said = ({g: sum(g in grams[t] for t in texts) for t in texts for g in grams[t]} for texts in (names, typed))
    n, v = len(names), len(typed)
    weight = lambda g: min(math.log(1 + n / held.get(g, 1)), math.log(1 + (v + n) / said.get(g, 1))) ** 0.5
    size = {t: sum(weight(g) ** 2 for g in grams[t]) ** 0.5 for t in grams}
    want = {(i, j): sum(weight(g) ** 2 for g in grams[x] & grams[y]) / size[x] / size[y] for i, x in enumerate(typed) for j, y in enumerate(names)}
    want = {k: c for k, c in want.items() if c >= least}
    got = {(r[0], r[1]): r[2] for r in retrieve(values, entries, least).select("value_id", "entry_id", "cosine").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_empty(spark):
    none = spark.createDataFrame([], "pid long, name string")
    some = spark.createDataFrame([(1, "a b")], "id long, value string")
    assert [r["pid"] for r in map_values(some, "id", "value", none, "pid", "name").collect()] == [-1]
    assert map_values(some.limit(0), "id", "value", none, "pid", "name").count() == 0


def test_parts(spark):
    assert plain(" Bícyclé-X1 ") == "bicycle x1"
    texts = spark.createDataFrame([(" Bícyclé-X1 ",), ("ab  CD!",), (None,), ("٣",), ("",)], "t string")
    assert [r[0] for r in texts.select(plain_form("t")).collect()] == ["bicycle x1", "ab cd", None, plain("٣"), ""]
    grams = spark.range(1).select(features(F.lit("ab cod"))).first()[0]
    assert sorted(grams) == sorted({"^a", "ab", "b$", "^ab", "ab$", "^c", "co", "od", "d$", "^co", "cod", "od$", "~ab", "~cd"})
