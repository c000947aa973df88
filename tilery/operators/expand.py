"""Alias patterns: `[a,b]` stands for a, b or nothing, `(a,b)` for a or b, other text for itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilery.functions.matchers import REGISTRY, RELAXED

# a bracket group, or a stretch of text; a bracket that belongs to no group is passed over
_PIECES = r"(\[[^\[\]]*\]|\([^()]*\)|[^\[^()]+)"


def expand_pattern(pattern: Column) -> Column:
    """All texts of a pattern, the last group varying fastest, as an array.

    A trailing comma in a group raises an error. A group whose first option is empty is left out. Null for null."""
    text = F.regexp_replace(pattern, r"(?U)\s+", " ")
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))

    def options(piece: Column) -> Column:
        inner = F.transform(F.split(F.substr(piece, F.lit(2), F.length(piece) - 2), ","), lambda x: F.trim(x))
        optional = piece.startswith("[")
        group = F.when(optional, F.concat(inner, F.array(F.lit("")))).otherwise(inner)
        empty = F.array().cast("array<string>")
        return F.when(optional | piece.startswith("("), F.when(inner[0] == "", empty).otherwise(group)).otherwise(F.array(F.trim(piece)))

    groups = F.filter(F.transform(pieces, options), lambda g: F.size(g) > 0)

    def combine(left: Column, right: Column) -> Column:
        return F.when(left == "", right).when(right == "", left).otherwise(F.concat_ws(" ", left, right))

    texts = F.aggregate(
        groups, F.array(F.lit("")), lambda acc, group: F.flatten(F.transform(acc, lambda left: F.transform(group, lambda right: combine(left, right))))
    )
    trailing = text.contains(",]") | text.contains(",)")
    return F.when(trailing, F.raise_error(F.concat(F.lit("illegal trailing comma in pattern: "), text)).cast("array<string>")).otherwise(texts)


def alias_matcher(expression: Column) -> Column:
    """The matcher of the registry that is named before the first colon, relaxed if there is none; another name raises an error."""
    named = F.trim(F.substring_index(expression, ":", 1))
    unknown = F.raise_error(F.concat(F.lit("unknown matcher: "), named)).cast("string")
    return F.when(F.instr(expression, ":") == 0, RELAXED).when(named.isin(*REGISTRY), named).otherwise(unknown)


def alias_pattern(expression: Column) -> Column:
    """What stands behind the first colon, or all of it."""
    at = F.instr(expression, ":")
    return F.when(at == 0, expression).otherwise(F.substr(expression, at + 1))
