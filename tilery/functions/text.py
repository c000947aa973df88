"""Normal form and terms, vectorised over Arrow string arrays."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are neither letters nor digits.
NOT_WORD = r"[^\p{L}\p{Nd}]+"
#: A matcher named before an alias.
LEADING_MATCHER = r"^[\s\p{Z}]*(?:exact|relaxed|prefix)[\s\p{Z}]*:"


def _strings(values: pa.Array) -> pa.Array:
    return values.cast(pa.large_string())


def folded(values: pa.Array) -> pa.Array:
    """NFKC and lower case. ASCII, nearly all of most columns, stays in Arrow; Arrow's own normaliser leaves
    composable characters apart, so each distinct other text goes through unicodedata."""
    values = _strings(values)
    ascii_only = pc.fill_null(pc.string_is_ascii(values), True)
    lower = pc.ascii_lower(values)
    if pc.all(ascii_only).as_py() is not False:
        return lower
    coded = values.filter(pc.invert(ascii_only)).dictionary_encode()
    other = [unicodedata.normalize("NFKC", x).lower() for x in coded.dictionary.to_pylist()]
    return pc.replace_with_mask(lower, pc.invert(ascii_only), pa.array(other, pa.large_string()).take(coded.indices))


def normalise(values: pa.Array, matcher: bool = False) -> pa.Array:
    """NFKC, lower case, without a leading matcher if asked, one blank for each run of other characters,
    no outer blanks. Nulls stay null."""
    out = folded(values)
    if matcher:
        out = pc.replace_substring_regex(out, pattern=LEADING_MATCHER, replacement="")
    return pc.utf8_trim(pc.replace_substring_regex(out, pattern=NOT_WORD, replacement=" "), characters=" ")


def flat(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The elements of a list array and the row each stands in; null and empty lists have none."""
    return lists.flatten(), pc.list_parent_indices(lists)


@F.arrow_udf(T.StringType())
def _name_form(values: pa.Array) -> pa.Array:
    return normalise(values).cast(pa.string())


@F.arrow_udf(T.StringType())
def _alias_form(values: pa.Array) -> pa.Array:
    return normalise(values, matcher=True).cast(pa.string())


def _relist(lists: pa.Array, items: pa.Array, rows: pa.Array, typ: pa.DataType) -> pa.Array:
    import numpy as np

    counts = np.bincount(np.asarray(rows), minlength=len(lists))
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), items.cast(typ))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _alias_forms(lists: pa.Array) -> pa.Array:
    items, rows = flat(lists)
    return _relist(lists, normalise(items, matcher=True), rows, pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _item_terms(names: pa.Array, lists: pa.Array) -> pa.Array:
    import numpy as np

    items, rows = flat(lists)
    texts = pa.concat_arrays([normalise(names), normalise(items, matcher=True)])
    owner = np.concatenate([np.arange(len(names)), np.asarray(rows)])
    words = pc.split_pattern(pc.fill_null(texts, ""), pattern=" ")
    terms, text = flat(words)
    filled = np.asarray(pc.greater(pc.utf8_length(terms), 0)) if len(terms) else np.zeros(0, bool)
    terms, row = terms.filter(pa.array(filled)), owner[np.asarray(text)[filled]]
    order = np.argsort(row, kind="stable")
    return _relist(names, terms.take(pa.array(order)), pa.array(row[order]), pa.string())


def name_form(column: Column | str) -> Column:
    """Normal form of a name."""
    return _name_form(column)


def alias_form(column: Column | str) -> Column:
    """Normal form of an alias: as of a name, without a leading matcher."""
    return _alias_form(column)


def alias_forms(column: Column | str) -> Column:
    """Normal forms of a list of aliases, in order; null elements stay null, a null list becomes empty."""
    return _alias_forms(column)


def item_terms(name: Column | str, aliases: Column | str) -> Column:
    """All terms of a name and its aliases, with repeats; null parts have none."""
    return _item_terms(name, aliases)
