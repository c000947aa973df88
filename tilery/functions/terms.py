"""Term model: breaking, stemming, hashing; each part can be replaced.

A term's hash lies in one of three ranges: words below 2^32, whole numbers from 2^32 on, token references,
terms that begin with an at-sign, from 2 * 2^32 on. A number of 2^32 or more lands in the third range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilery.functions.stemming import stem_english

#: Size of a hash range.
RANGE = 1 << 32
_MASK = RANGE - 1


def murmur3(data: bytes, seed: int = 0) -> int:
    """Murmur3, 32 bits."""
    rotate = lambda x, r: ((x << r) | (x >> (32 - r))) & _MASK
    mix = lambda k: rotate(k * 0xCC9E2D51 & _MASK, 15) * 0x1B873593 & _MASK
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rotate(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & _MASK
    if whole < len(data):
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * factor & _MASK
    return h


def hash_stem(stem: str) -> int:
    """Hash of a stemmed term, in its range."""
    if stem.startswith("@"):
        return murmur3(stem.encode()) + 2 * RANGE
    if stem.isascii() and stem.isdigit():
        return int(stem) + RANGE
    return murmur3(stem.encode())


def stem_term(term: str, stemmer: Callable[[str], str] = stem_english) -> str:
    """Stem of a term in lower case; token references stay as they are."""
    return term if term.startswith("@") else stemmer(term.lower())


@dataclass(frozen=True)
class TermModel:
    """breaker and column_stemmer are Column functions; stemmer is a Python function, used on distinct terms.

    With column_stemmer, stems are made inside Spark's own expressions and stemmer isn't called."""

    stemmer: Callable[[str], str] = stem_english
    column_stemmer: Callable[[Column], Column] | None = None
    breaker: Callable[[Column], Column] | None = None

    def breaks(self, text: Column) -> Column:
        return (self.breaker or word_break)(text)

    def stem_and_hash(self, term: str) -> int:
        return hash_stem(stem_term(term, self.stemmer))


def word_break(text: Column) -> Column:
    """Parts between runs of white space, empty ones at either end included."""
    return F.split(text, r"(?U)\s+", -1)


def strip_plural(term: Column) -> Column:
    """A stemmer of Spark expressions: lower case, without one final s."""
    return F.regexp_replace(F.lower(term), "s$", "")


def number_hash(value: Column) -> Column:
    return value.cast("bigint") + F.lit(RANGE)


def is_number_hash(hashed: Column) -> Column:
    return (hashed >= RANGE) & (hashed < 2 * RANGE)


def is_token_hash(hashed: Column) -> Column:
    return hashed >= 2 * RANGE


@F.pandas_udf(T.LongType())
def hash_of_stem(stems: pd.Series) -> pd.Series:
    return stems.map(lambda x: None if x is None else hash_stem(x)).astype("Int64")


def dictionary(terms: DataFrame, term: str, model: TermModel = TermModel()) -> DataFrame:
    """(term, stem, hash) of the distinct non-null terms: Python sees each distinct term once."""
    own = terms.select(F.col(term).alias("term")).where(F.col("term").isNotNull()).distinct()
    if model.column_stemmer is not None:
        plain = F.when(F.col("term").startswith("@"), F.col("term")).otherwise(model.column_stemmer(F.col("term")))
        stemmed = own.withColumn("stem", plain)
    else:
        stemmer = model.stemmer
        udf = F.pandas_udf(lambda x: x.map(lambda t: stem_term(t, stemmer)), T.StringType())
        stemmed = own.withColumn("stem", udf("term"))
    return stemmed.withColumn("hash", hash_of_stem("stem"))


def decode(hashed: Column, text: Column) -> Column:
    """The stem of a hash, or a mark of an unknown one."""
    return F.coalesce(text, F.concat(F.lit("###HASH"), hashed.cast("string"), F.lit("###")))
