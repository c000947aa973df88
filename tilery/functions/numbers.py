"""English number phrases: which numbers the head of a word sequence may stand for; and numbers to words.

Words fall into classes; a phrase is a run of periods of falling magnitude. Every number that a longer and
longer head of the sequence completes is reported in order, as (value, words counted). `and` after `hundred` is
passed over and not counted; `hundred` is withheld where only a final unit follows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabulary.
UNITS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
MAGNITUDES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
VOCABULARY = ("a", "and", "hundred", "zero", *UNITS, *TENS, *MAGNITUDES)

Match = tuple[int, int]


class NumberGrammar:
    """Reads sequences of words, or of what `key` makes of words (stems, hashes)."""

    def __init__(self, key=None):
        key = key or (lambda word: word)
        self.units = {key(w): v for w, v in UNITS.items()}
        self.tens = {key(w): v for w, v in TENS.items()}
        self.magnitudes = {key(w): m for w, m in MAGNITUDES.items()}
        self.a, self.conjunction, self.hundred, self.zero = (key(w) for w in ("a", "and", "hundred", "zero"))
        #: What a number can begin with.
        self.first = {self.a, self.zero, *self.units, *self.tens}

    def __call__(self, words: Sequence) -> list[Match]:
        if len(words) and words[0] == self.zero:
            return [(0, 1)]
        out: list[Match] = []
        at, total, counted, ceiling = 0, 0, 0, None
        while at < len(words):
            period = self._period(words, at, total, counted, out)
            if period is None:
                break
            at, value, length, magnitude = period
            if ceiling is not None and magnitude >= ceiling:
                break
            total, counted, ceiling = total + value, counted + length, magnitude
            out.append((total, counted))
        return out

    def _period(self, words, at, total, counted, out):
        """(next place, value, words counted, magnitude) of the period at a place, or None."""
        word = words[at] if at < len(words) else None
        hundred_may_follow = word == self.a
        if hundred_may_follow:
            at, value, length = at + 1, 1, 1
        else:
            below = self._below_hundred(words, at, total, counted, out)
            if below is None:
                return None
            at, value, length = below
            hundred_may_follow = value % 10 != 0
        if hundred_may_follow and at < len(words) and words[at] == self.hundred:
            if word != self.a:
                out.append((total + value, counted + length))
            at, value, length = at + 1, value * 100, length + 1
            out.append((total + value, counted + length))
            reported = len(out)
            rest = at + 1 if at < len(words) and words[at] == self.conjunction else at
            below = self._below_hundred(words, rest, total + value, counted + length, out)
            at = below[0] if below else rest
            if below:
                value, length = value + below[1], length + below[2]
            if len(out) == reported:
                out.pop()
        magnitude = self.magnitudes.get(words[at], 0) if at < len(words) else 0
        if magnitude:
            out.append((total + value, counted + length))
            at, value, length = at + 1, value * 10**magnitude, length + 1
        return at, value, length, magnitude

    def _below_hundred(self, words, at, total, counted, out):
        """(next place, value, words counted) of a number from 1 to 99 at a place, or None."""
        if at >= len(words):
            return None
        if words[at] in self.units:
            return at + 1, self.units[words[at]], 1
        tens = self.tens.get(words[at])
        if tens is None:
            return None
        digit = self.units.get(words[at + 1], 10) if at + 1 < len(words) else 10
        if digit > 9:
            return at + 1, tens, 1
        out.append((total + tens, counted + 1))
        return at + 2, tens + digit, 2


MATCHES = T.ArrayType(T.StructType([T.StructField("value", T.LongType()), T.StructField("length", T.IntegerType())]))


def number_matches(words: Column | str, grammar: Callable[[list], list[Match]] | None = None) -> Column:
    """All numbers at the head of a list of words, or of hashes if that is what the grammar reads; null for a null list."""
    read = grammar or NumberGrammar()

    def matches(lists: pa.Array) -> pa.Array:
        found = [None if x is None else [{"value": v, "length": n} for v, n in read(x)] for x in lists.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("value", pa.int64()), ("length", pa.int32())])))

    return F.arrow_udf(matches, MATCHES)(words)


def number_words(value: int) -> str:
    """A whole number in words, without `and`: twenty-one, one thousand, fifty."""
    if value < 0:
        return "minus " + number_words(-value)
    if value == 0:
        return "zero"
    small, tens = {v: w for w, v in UNITS.items()}, {v: w for w, v in TENS.items()}

    def below_thousand(n: int) -> str:
        words = []
        if n >= 100:
            words.append(f"{small[n // 100]} hundred")
            n %= 100
        if n >= 20:
            words.append(tens[n // 10 * 10] + (f"-{small[n % 10]}" if n % 10 else ""))
        elif n:
            words.append(small[n])
        return " ".join(words)

    parts, scales = [], [(10**m, w) for w, m in sorted(MAGNITUDES.items(), key=lambda x: -x[1])]
    for scale, word in scales:
        if value >= scale:
            parts.append(f"{number_words(value // scale)} {word}")
            value %= scale
    if value:
        parts.append(below_thousand(value))
    return ", ".join(parts)


def _below_thousand() -> list[str]:
    return ["", *(number_words(n) for n in range(1, 1000))]


def digits_to_words(value: Column | str) -> Column:
    """A number in words, with its first hyphen as a blank and its first comma left out; null stays null. Expressions over a
    table of the words below a thousand."""
    value = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    # one literal after constant folding
    small, names = F.split(F.lit(",".join(_below_thousand())), ","), {m: w for w, m in MAGNITUDES.items()}

    def join(periods: list[Column]) -> Column:
        return F.array_join(F.array_compact(F.array(*periods)), ", ")

    def period(n: Column, magnitude: int) -> Column:
        words = F.get(small, (F.floor(n / 10**magnitude) % 1000).cast("int"))
        return F.when(words != "", F.concat(words, F.lit(f" {names[magnitude]}")) if magnitude else words)

    def spell(n: Column) -> Column:
        rest = n % 10**12
        trillions = ((n - rest) / 10**12).cast("bigint")
        head = F.when(trillions > 0, F.concat(join([period(trillions, m) for m in (6, 3, 0)]), F.lit(" trillion")))
        return F.when(n == 0, F.lit("zero")).otherwise(join([head, *(period(rest, m) for m in (9, 6, 3, 0))]))

    words = F.concat(F.when(value < 0, F.lit("minus ")).otherwise(F.lit("")), spell(F.abs(value)))
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(words, "^([^-]*)-", "$1 "), "^([^,]*),", "$1"))
