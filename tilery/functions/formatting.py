"""Tokens as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(value: Column) -> Column:
    """A number without a fraction as a whole number."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def token_text(kind: Column, pid: Column, name: Column, value: Column, text: Column) -> Column:
    """[ATTRIBUTE:NAME,pid], [ENTITY:NAME,pid], [name] of an intent, [QUANTIFIER:v], [NUMBER:v], [WORD:text], [UNKNOWN], else the kind itself in brackets."""
    label = F.upper(F.regexp_replace(name, r"(?U)\s", "_"))
    named = F.concat(F.lit("["), kind, F.lit(":"), label, F.lit(","), pid.cast("string"), F.lit("]"))
    valued = F.concat(F.lit("["), kind, F.lit(":"), number_text(value), F.lit("]"))
    return (
        F.when(kind.isin("ATTRIBUTE", "ENTITY"), named)
        .when(kind == "INTENT", F.concat(F.lit("["), name, F.lit("]")))
        .when(kind.isin("QUANTIFIER", "NUMBER"), valued)
        .when(kind == "WORD", F.concat(F.lit("[WORD:"), text, F.lit("]")))
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )


def label_form(token: Column) -> Column:
    """A token text typed by hand, without brackets, as the formatter writes it: in the label of an entity or attribute every run
    of other characters than letters and digits is one underscore."""
    parts = lambda i: F.regexp_extract(token, r"^\s*(ENTITY|ATTRIBUTE)\s*:(.*?),\s*(-?\d+)\s*$", i)
    label = F.regexp_replace(F.regexp_replace(F.upper(parts(2)), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")
    return F.when(parts(1) != "", F.concat(parts(1), F.lit(":"), label, F.lit(","), parts(3))).otherwise(F.regexp_replace(token, '"', ""))
