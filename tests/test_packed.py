"""The packed-field splitter against readers that go character by character."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilery.operators.packed import BRACKETED, SEPARATED, flatten_lists, split_cells, split_packed

WORD = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-.")


def read_separated(s):
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c in WORD:
            j = i
            while j < len(s) and (s[j] in WORD or s[j] == "'"):
                j += 1
            out.append(s[i:j])
            i = j
        elif c == "“" and "”" in s[i:]:
            j = s.index("”", i)
            out.append(s[i + 1 : j])
            i = j + 1
        elif c in "\"'":
            j, value, closed = i + 1, "", False
            while j < len(s) and not closed:
                if s[j] == c and s[j + 1 : j + 2] == c:
                    value += c
                    j += 2
                elif s[j] == c:
                    closed = True
                else:
                    value += s[j]
                    j += 1
            if closed:
                out.append(value)
                i = j + 1
            else:
                while i < len(s) and s[i] == c:
                    i += 1
        else:
            i += 1
    return [x for x in out if x]


def read_bracketed(s):
    token, out, i = (WORD - set("-.")) | {":"}, [], 0
    while i < len(s):
        if s[i] == "[":
            j, quoted = i + 1, False
            while j < len(s) and (quoted or s[j] != "]"):
                quoted ^= s[j] == '"'
                j += 1
            if j < len(s):
                out.append(s[i + 1 : j])
                i = j + 1
                continue
        elif s[i] in token:
            j = i
            while j < len(s) and s[j] in token:
                j += 1
            out.append(s[i:j])
            i = j
            continue
        i += 1
    return [x for x in out if x]


def split(cells, grammar):
    values, parent, pos = flatten_lists(split_cells(pa.array(cells, pa.string()), grammar))
    out = [[] for _ in cells]
    for value, p, at in zip(values.to_pylist(), parent, pos):
        assert at == len(out[p])
        out[p].append(value)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab'\"“”,; é-", max_size=16), max_size=12))
def test_separated_like_a_reader(cells):
    assert split(cells, SEPARATED) == [read_separated(c) for c in cells]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('ab:[]"", -é', max_size=16), max_size=12))
def test_bracketed_like_a_reader(cells):
    assert split(cells, BRACKETED) == [read_bracketed(c) for c in cells]


@pytest.mark.parametrize(
    "cell, want",
    [
        ("general; smoke,,general", ["general", "smoke", "general"]),
        ('"the ""odd"" ones" driver\'s-choice', ['the "odd" ones', "driver's-choice"]),
        ("'it''s late'|v2.1", ["it's late", "v2.1"]),
        ('“the "odd" ones” + b', ['the "odd" ones', "b"]),
        ('"" \'\' a', ["a"]),
        ('"open a', ["open", "a"]),
        ("", []),
        ("   ", []),
        (None, []),
    ],
)
def test_separated_cases(cell, want):
    assert split([cell], SEPARATED)[0] == want


def test_long_cells_and_many_tokens():
    cell = "[a]x[\"b]\"]" * 50_000
    assert len(split([cell, "c"], BRACKETED)[0]) == 150_000
    assert split(["'a' " * 100_000], SEPARATED)[0] == ["a"] * 100_000


def test_frame_with_nulls_and_clashing_names(spark):
    rows = [(1, "a b", "[X] y", "p"), (2, None, "", "q"), (None, "c", None, None), (1, "a b", "[X] y", "p")]
    frame = spark.createDataFrame(rows, "id long, suites string, expected string, pos string")
    got = sorted(map(tuple, split_packed(frame, "id", {"suites": SEPARATED, "expected": BRACKETED}).collect()), key=str)
    one = [(1, "suites", 0, "a"), (1, "suites", 1, "b"), (1, "expected", 0, "X"), (1, "expected", 1, "y")]
    assert got == sorted([*one, *one, (None, "suites", 0, "c")], key=str)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "id long, suites string")
    assert split_packed(frame, "id", {"suites": SEPARATED}).count() == 0
