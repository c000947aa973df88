"""Normaliser of transcribed speech."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilery.functions.numbers import digits_to_words

# Fixed values.
SPOKEN = {"okay": "ok", "1/2": "half", "1/4": "quarter"}


def speech_text(text: Column) -> Column:
    """Speech text as utterance words, in this order: the first & and % spelt out, curly quotes made straight,
    punctuation to blanks, blanks collapsed, whole numbers in words, words replaced by
    SPOKEN. Null stays null."""
    out = F.regexp_replace(text, "^([^&]*)&", "$1 and ")
    out = F.regexp_replace(out, "^([^%]*)%", "$1 percent ")
    out = F.regexp_replace(F.regexp_replace(out, "[‘’]", "'"), "[“”]", '"')
    out = F.regexp_replace(out, r'[,.?!"\-()]', " ")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    spoken = F.create_map(*[F.lit(x) for pair in SPOKEN.items() for x in pair])
    words = F.transform(F.split(out, " "), lambda w: F.coalesce(F.try_element_at(spoken, F.lower(w)), w))
    # a number of more digits than a bigint holds stays as it is
    number = lambda w: F.when(w.rlike("^[0-9]{1,18}$"), digits_to_words(w)).otherwise(w)
    return F.array_join(F.transform(words, number), " ")
