"""Terms, stems, hashes, matchers, numbers, speech: golden values."""

import pytest
from pyspark.sql import functions as F

from tilery.functions import matchers as M
from tilery.functions.formatting import token_text
from tilery.functions.numbers import NumberGrammar, digits_to_words, number_matches, number_words
from tilery.functions.speech import speech_text
from tilery.functions.stemming import stem_english
from tilery.functions.terms import RANGE, TermModel, hash_stem, murmur3, stem_term, word_break


def test_hashes():
    model = TermModel()
    assert [model.stem_and_hash(w) for w in "small unsweeten ice tea".split()] == [2557986934, 1506511588, 4077993285, 1955911164]
    assert hash_stem("5") == RANGE + 5
    assert hash_stem("@QUANTITY") == murmur3(b"@QUANTITY") + 2 * RANGE
    assert stem_term("@Running") == "@Running"


def test_stems():
    words = "red convertible sedan rims tires knobby spinners slicks turbo charger"
    assert [stem_term(w) for w in words.split()] == "red convert sedan rim tire knobbi spinner slick turbo charger".split()
    pairs = {"consistency": "consist", "hopping": "hop", "hoping": "hope", "generously": "generous", "skies": "sky", "cried": "cri", "ties": "tie", "national": "nation", "by": "by"}
    assert {w: stem_english(w) for w in pairs} == pairs


@pytest.mark.parametrize(
    "query, prefix, want",
    [
        ("abcdef", "ab", ("ab", 0, 0, 1, 2)), ("abcdef", "bcd", ("bcd", 1, 1, 3, 3)), ("abcdef", "cde", ("cde", 2, 2, 4, 3)),
        ("abcdef", "f", ("f", 5, 5, 5, 1)), ("abcdef", "ac", ("ac", 1, 0, 2, 2)), ("abcdef", "ad", ("ad", 2, 0, 3, 2)),
        ("abcdef", "adf", ("adf", 3, 0, 5, 3)), ("a", "af", ("a", 1, 0, 0, 1)), ("a", "def", ("a", 3, 0, 0, 0)), ("abc", "adc", ("abc", 1, 0, 2, 2)),
    ],
)
def test_levenshtein(query, prefix, want):
    assert M.match_string(query, prefix, M.levenshtein) == want


def test_levenshtein_tokens_and_wildcards():
    wild = M.levenshtein([1, 2, 3, 4, 5], [1, -1, 3], equal=lambda a, b: b < 0 or a == b)
    assert (wild.match, wild.cost) == ([1, 2, 3], 0)
    assert (M.levenshtein([1, 2, 3, 4, 5], [1, 6]).match, M.levenshtein([1, 2, 3, 4, 5], [1, 6]).cost) == ([1, 2], 1)
    token = lambda x: x >= 2 * RANGE
    query = [2641553256, 9915785936, 2779594451, 1009084850]
    assert M.levenshtein(query, [2641553256, 455026286], token, token).cost == 1
    assert M.levenshtein(query, [2641553256, 9915785936], token, token).cost == 0
    last = M.levenshtein([1, 0x200000001, 0x200000002], [1, 0x200000001, 0x200000003], lambda x: x == 0x200000001, token)
    assert (last.match, last.cost, last.alignments) == ([1], 1, 1)
    long = M.levenshtein([1, 2, 3, 4, 5, 6, 7, 8, 9, 8589934592, 11, 2, 13, 14, 15, 16], [1, 2, 3, 4, 5, 6], token, token)
    assert (long.match, long.cost) == ([1, 2, 3, 4, 5, 6], 0)


EXACT = [
    (False, "abcdef", "abcd", "", ("abcd", 0, 0, 3, 4)), (False, "abcdef", "bcd", "", ("", 3, -1, -1, 0)),
    (False, "abcdef", "abcdefg", "", ("", 7, -1, -1, 0)), (True, "abcdef", "abx", "", ("ab", 1, 0, 1, 2)),
    (True, "abcdef", "abcdefg", "", ("abcdef", 1, 0, 5, 6)), (True, "abcdef", "bcd", "", ("", 3, -1, -1, 0)),
    (True, "xycdef", "xy", "xyz", ("xy", 0, 0, 1, 2)), (True, "abxyef", "abxy", "xyz", ("abxy", 0, 0, 3, 4)),
    (True, "abxdef", "abxp", "xyz", ("ab", 2, 0, 1, 2)), (True, "xycdef", "xyp", "xyz", ("", 3, -1, -1, 0)), (True, "abcdef", "xyz", "xyz", ("", 3, -1, -1, 0)),
]


@pytest.mark.parametrize("partial, query, prefix, down, want", EXACT)
def test_exact_prefix(partial, query, prefix, down, want):
    assert M.match_string(query, prefix, M.exact_prefix, partial=partial, downstream=lambda x: x in down) == want


def test_exact_prefix_column_agrees(spark):
    code = lambda s: [ord(c) for c in s]
    rows = [(i, p, code(q), code(a), code(d)) for i, (p, q, a, d, _) in enumerate(EXACT)]
    frame = spark.createDataFrame(rows, "i int, partial boolean, q array<bigint>, p array<bigint>, d array<bigint>")
    got = {r["i"]: r["m"] for r in frame.select("i", M.exact_prefix_column(F.col("q"), F.col("p"), F.col("partial"), F.col("d")).alias("m")).collect()}
    for i, (*_, want) in enumerate(EXACT):
        m = got[i]
        assert ("".join(map(chr, m["match"])), m["cost"], m["leftmost"], m["rightmost"], m["alignments"]) == want


SCORES = [
    ("red sedan", "red sedan", "relaxed", 2.0, 2), ("red big sedan", "red sedan", "relaxed", 4 / 3, 3), ("sedan", "red sedan", "relaxed", 0.5, 1),
    ("1 2 3 4 5", "1 6", "relaxed", 0.5, 2), ("red car", "red sedan", "prefix", 0.5, 1), ("red car", "red sedan", "exact", None, 0),
]


@pytest.mark.parametrize("query, alias, matcher, score, length", SCORES)
def test_scores(query, alias, matcher, score, length):
    value, covered = M.score(alias.split(), M.REGISTRY[matcher](query.split(), alias.split()))
    assert covered == length and (value == score if score is None else value == pytest.approx(score))


def test_score_column_agrees(spark):
    code = lambda s: [sum(map(ord, w)) for w in s.split()]
    frame = spark.createDataFrame([(i, code(q), code(a)) for i, (q, a, *_) in enumerate(SCORES)], "i int, q array<bigint>, p array<bigint>")
    none = F.array().cast("array<bigint>")
    relaxed = frame.withColumn("d", M.levenshtein_column("q", "p", none)).select("i", M.score_column(F.col("d"), F.col("p"), none).alias("s"))
    got = {r["i"]: r["s"] for r in relaxed.collect()}
    for i, (*_, matcher, score, length) in enumerate(SCORES):
        if matcher == "relaxed":
            assert got[i]["score"] == pytest.approx(score) and got[i]["length"] == length


def test_all_downstream_is_rejected():
    diff = M.levenshtein(["with", "roof"], ["with", "rack"], lambda x: x == "with")
    assert M.score(["with", "rack"], diff, lambda x: x == "with")[0] in (None, M.REJECTED)


NUMBERS = {
    "a hundred": [(100, 2)], "one hundred": [(1, 1), (100, 2)], "two thousand": [(2, 1), (2000, 2)], "twenty one": [(20, 1), (21, 2)],
    "one hundred thirty two": [(1, 1), (100, 2), (130, 3), (132, 4)], "a hundred thirty two": [(100, 2), (130, 3), (132, 4)],
    "one hundred and thirty two": [(1, 1), (100, 2), (130, 3), (132, 4)], "twenty thousand": [(20, 1), (20000, 2)],
    "thirty seven hundred fifty nine": [(30, 1), (37, 2), (3700, 3), (3750, 4), (3759, 5)],
    "one hundred million": [(1, 1), (100, 2), (100000000, 3)], "one hundred five": [(1, 1), (105, 3)],
    "five thousand six million three": [(5, 1), (5000, 2), (5006, 3)], "ten three": [(10, 1)], "twenty zero": [(20, 1)], "twenty hundred": [(20, 1)],
    "five thousand six horses in the herd": [(5, 1), (5000, 2), (5006, 3)], "two thousand thousand": [(2, 1), (2000, 2)],
    "sequence with no numbers": [], "": [], "zero": [(0, 1)], "nineteen": [(19, 1)], "five trillion": [(5, 1), (5 * 10**12, 2)],
    "eight hundred sixty four million two hundred eighty eight thousand seven hundred ninety one": [
        (8, 1), (800, 2), (860, 3), (864, 4), (864000000, 5), (864000002, 6), (864000200, 7), (864000280, 8), (864000288, 9), (864288000, 10),
        (864288007, 11), (864288700, 12), (864288790, 13), (864288791, 14)],
}


@pytest.mark.parametrize("phrase", NUMBERS)
def test_numbers(phrase):
    assert NumberGrammar()(phrase.split()) == NUMBERS[phrase]
    assert NumberGrammar(hash_stem)([hash_stem(w) for w in phrase.split()]) == NUMBERS[phrase]


def test_number_words_round_trip():
    read = NumberGrammar()
    for n in [*range(1000), 1000, 1050, 21_000, 999_999, 10**6 + 1, 7 * 10**12 + 8]:
        words = number_words(n).replace("-", " ").replace(",", "").split()
        assert read(words)[-1][0] == n


def test_number_column(spark):
    frame = spark.createDataFrame([(["twenty", "one"],), (None,), ([],)], "w array<string>")
    got = [r[0] for r in frame.select(number_matches("w")).collect()]
    assert [[tuple(m) for m in x] if x is not None else None for x in got] == [[(20, 1), (21, 2)], None, []]


def test_speech(spark):
    cases = {
        "one & two": "one and two", "one % two": "one percent two", 'a,b.c?d!e-f(g)h"i': "a b c d e f g h i", "it‘s ’x": "it's 'x",
        "  a   b ": "a b", "a 23 b 4 c": "a twenty three b four c", "a 1050 b": "a one thousand fifty b", "okay 1/2 1/4": "ok half quarter", "": "",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string").select("t", speech_text(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in frame.collect()} == cases
    assert spark.createDataFrame([(None,)], "t string").select(speech_text(F.col("t"))).first()[0] is None


def test_word_break_keeps_edges(spark):
    assert spark.createDataFrame([(" a b ",)], "t string").select(word_break(F.col("t"))).first()[0] == ["", "a", "b", ""]


def test_token_text(spark):
    rows = [("ENTITY", 7, "Red Car", None, None, "[ENTITY:RED_CAR,7]"), ("INTENT", 1, "ADD", None, None, "[ADD]"), ("QUANTIFIER", 1, "one", 1.0, None, "[QUANTIFIER:1]"),
            ("NUMBER", None, None, 2.5, None, "[NUMBER:2.5]"), ("WORD", None, None, None, "BIG", "[WORD:BIG]"), ("UNKNOWN", None, None, None, None, "[UNKNOWN]")]
    frame = spark.createDataFrame(rows, "k string, pid long, name string, value double, text string, want string")
    got = frame.select(token_text(F.col("k"), F.col("pid"), F.col("name"), F.col("value"), F.col("text")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_reader():
    from tilery.functions.sequence import Reader

    reader = Reader("ab")
    assert reader.peek() == "a" and reader.get() == "a" and not reader.at_end()
    assert not reader.skip(lambda x: x == "a") and reader.next_is(lambda x: x == "b") and reader.skip(lambda x: x == "b") and reader.at_end()
    assert not reader.next_is(lambda x: True) and not reader.skip(lambda x: True)
    for beyond in (reader.peek, reader.get):
        with pytest.raises(TypeError):
            beyond()


@pytest.mark.parametrize("value, words", [
    (0, "zero"), (21, "twenty one"), (99, "ninety nine"), (100, "one hundred"), (1050, "one thousand fifty"), (21_021, "twenty one thousand twenty-one"),
    (1_002_003, "one million two thousand, three"), (999_999_999_999_999, None), (-5, "minus five"), (10**15, "one thousand trillion"), (9_223_372_036_854_775_807, None), (None, None),
])
def test_digits_to_words(spark, value, words):
    got = spark.createDataFrame([(value,)], "v long").select(digits_to_words("v")).first()[0]
    assert got == (words if words or value is None else number_words(value).replace("-", " ", 1).replace(",", "", 1))


def test_labels_as_typed(spark):
    from tilery.functions.formatting import label_form

    cases = {'ENTITY:"CRIMSON, CYCLOCROSS, BICYCLE",6': "ENTITY:CRIMSON_CYCLOCROSS_BICYCLE,6", "ENTITY:ALUMINIUM [BOTTLE],1018": "ENTITY:ALUMINIUM_BOTTLE,1018",
             "ENTITY:RUBBER_BOTTLE,7": "ENTITY:RUBBER_BOTTLE,7", "QUANTIFIER:1": "QUANTIFIER:1", "END_OF_ORDER": "END_OF_ORDER", "WORD:A_B": "WORD:A_B"}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in frame.select("t", label_form(F.col("t")).alias("x")).collect()} == cases
