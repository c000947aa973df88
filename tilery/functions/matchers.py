"""Matchers of a query tail against an alias, and the score of a match.

A matcher says what stretch of the query an alias (the prefix) accounts for. `exact` and `prefix` compare term by
term from the start and are Spark expressions; `relaxed` aligns by edit distance, all pairs of equal lengths of an Arrow
batch at once. Terms are hashes; a term is downstream if it is a number, a token reference or a term of another domain.
Column functions take that as flags, an array of booleans beside the query, or as an array of downstream terms.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilery.functions.terms import RANGE

#: What deleting or replacing a token reference costs.
TOKEN_COST = float(RANGE)
EXACT, PREFIX, RELAXED = "exact", "prefix", "relaxed"
#: Scores up to this are rejected.
LOW = 0.01
REJECTED = -1.0


@dataclass
class Diff:
    match: list = field(default_factory=list)
    cost: float = 0
    leftmost: int = -1
    rightmost: int = -1
    alignments: int = 0
    common: list = field(default_factory=list)


def same(a: Hashable, b: Hashable) -> bool:
    return a == b


def no_term(_: Hashable) -> bool:
    return False


def exact_prefix(query: Sequence, prefix: Sequence, partial: bool = False, downstream: Callable = no_term, equal: Callable = same) -> Diff:
    """The common start of query and prefix; unless partial, all of the prefix or nothing. A partial match that stops
    short gives up downstream terms at its end."""
    size = 0
    for a, b in zip(query, prefix):
        if not equal(a, b):
            break
        size += 1
    whole = size == len(prefix)
    if not whole:
        if not partial:
            size = 0
        while size and downstream(query[size - 1]):
            size -= 1
    match = list(query[:size])
    return Diff(match, len(prefix) - size, 0 if size else -1, size - 1, size, list(dict.fromkeys(match)))


@dataclass
class Alignments:
    """Alignments of many pairs: a number each, and masks over the query terms."""

    cost: np.ndarray
    leftmost: np.ndarray
    rightmost: np.ndarray
    alignments: np.ndarray
    match: np.ndarray
    common: np.ndarray


_STOP, _SKIP, _SKIP_PREFIX, _PAIR = range(4)
#: Cells of the tables of costs that are filled at once.
CELLS = 4_000_000


def align(equal: np.ndarray, down: np.ndarray, fixed: np.ndarray) -> Alignments:
    """Edit distances of prefixes to heads of queries: pairs x query terms x prefix terms, which of them are equal; which
    query terms are downstream, and which are token references.

    Among equal costs, leaving out a query term goes before leaving out a prefix term, and that before pairing two
    terms. Token references are neither left out nor replaced at the end. Query terms left out behind the last
    pair are no part of the match and cost nothing. Until a first term is taken from the right, downstream terms
    are passed over, unless they meet the last term of the prefix.
    """
    pairs, width, height = equal.shape
    dear = np.where(fixed, TOKEN_COST, 1.0)
    cost = np.zeros((height + 1, width + 1, pairs))
    move = np.zeros((height + 1, width + 1, pairs), np.int8)
    cost[0, 1:] = np.cumsum(dear, axis=1).T
    for b in range(1, height + 1):
        cost[b, 0] = b
        for a in range(1, width + 1):
            options = np.stack([
                cost[b, a - 1] + dear[:, a - 1],
                cost[b - 1, a] + 1,
                np.where(equal[:, a - 1, b - 1], cost[b - 1, a - 1], np.where(fixed[:, a - 1], TOKEN_COST, cost[b - 1, a - 1] + 1)),
            ])
            move[b, a] = options.argmin(axis=0) + 1
            cost[b, a] = options.min(axis=0)
    every = np.arange(pairs)
    # back from the longest head that token references don't make too dear
    a = width - np.argmax((cost[height] < TOKEN_COST)[::-1], axis=0) if pairs else np.zeros(0, int)
    a = np.where((cost[height] < TOKEN_COST).any(axis=0), a, 0)
    b = np.full(pairs, height)
    out = Alignments(cost[height, a, every], np.full(pairs, -1), np.full(pairs, -1), np.zeros(pairs, int), np.zeros((pairs, width), bool), np.zeros((pairs, width), bool))
    paired, taken = np.zeros(pairs, bool), np.zeros(pairs, bool)
    while (live := every[move[b, a, every] != _STOP]).size:
        how = move[b[live], a[live], live]
        skipped = live[how == _SKIP]
        free = skipped[~paired[skipped]]
        out.cost[free] = cost[b[free], a[free] - 1, free]
        met = live[how == _PAIR]
        at = a[met] - 1
        same_term = equal[met, at, b[met] - 1]
        kept = taken[met] | ~down[met, at] | (same_term & (b[met] == height))
        own, places, same_term = met[kept], at[kept], same_term[kept]
        out.match[own, places] = True
        out.rightmost[own] = np.where(taken[own], out.rightmost[own], places)
        taken[own] = True
        out.common[own[same_term], places[same_term]] = True
        out.alignments[own[same_term]] += 1
        paired[met] = True
        left = live[how != _SKIP_PREFIX]
        a[left] -= 1
        out.leftmost[left] = a[left]
        b[live[how != _SKIP]] -= 1
    return out


def levenshtein(query: Sequence, prefix: Sequence, downstream: Callable = no_term, token: Callable = no_term, equal: Callable = same) -> Diff:
    """`align` of one pair of any terms, with any equality."""
    query, prefix = list(query), list(prefix)
    table = np.array([equal(x, y) for x in query for y in prefix], bool).reshape(1, len(query), len(prefix))
    found = align(table, np.array([[bool(downstream(x)) for x in query]], bool).reshape(1, -1), np.array([[bool(token(x)) for x in query]], bool).reshape(1, -1))
    places = np.flatnonzero(found.match[0]).tolist()
    common = [query[i] for i in np.flatnonzero(found.common[0])[::-1]]
    return Diff([query[i] for i in places], float(found.cost[0]), int(found.leftmost[0]), int(found.rightmost[0]), int(found.alignments[0]), list(dict.fromkeys(common)))


def _distinct(terms: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """How many different terms the mask of each row covers."""
    out = np.zeros(len(terms), int)
    for i in range(terms.shape[1]):
        before = (mask[:, :i] & (terms[:, :i] == terms[:, i : i + 1])).any(axis=1)
        out += mask[:, i] & ~before
    return out


def score_alignments(query: np.ndarray, prefix: np.ndarray, found: Alignments, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`score` of many pairs: scores, not a number where nothing matched, and query terms covered."""
    length, size, cost = found.rightmost + 1, found.match.sum(axis=1), found.cost
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(length > cost, (length - cost) / length, 1 / (length + cost))
        common = _distinct(query, found.common)
        value = value * (common / _distinct(query, found.match))
        value = value * (np.maximum(size - found.leftmost, 0) / size * size)
    below = (down | ~found.common).all(axis=1) & (common > 0) & (common != _distinct(prefix, np.ones(prefix.shape, bool)))
    value = np.where(below | (value <= LOW), REJECTED, value)
    return np.where(size > 0, value, np.nan), length


def groups(*lengths: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Rows of equal lengths, together, so many that their tables have about `cells` cells."""
    order = np.lexsort(lengths)
    keys = np.stack([x[order] for x in lengths])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            most = max(int(cells // np.prod([x[rows[0]] + 1.0 for x in lengths])), 1)
            yield from (rows[i : i + most] for i in range(0, len(rows), most))


def _block(lists: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The elements of lists of equal lengths, a row each."""
    offsets, values = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
    size = int(offsets[rows[0] + 1] - offsets[rows[0]])
    return values[offsets[rows][:, None] + np.arange(size)]


def _aligned(query: pa.Array, prefix: pa.Array, flags: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Alignments]]:
    """(rows, query, prefix, downstream, alignments) of the rows of list arrays, group by group."""
    query, prefix, flags = (pa.concat_arrays([x.slice(0, 0), x]) for x in (query, prefix, flags))
    sizes = [np.diff(np.asarray(x.offsets)) for x in (query, prefix)]
    for rows in groups(*sizes):
        q, p = _block(query, rows), _block(prefix, rows)
        down = _block(flags, rows).astype(bool) | (q >= RANGE)
        yield rows, q, p, down, align(q[:, :, None] == p[:, None, :], down, q >= 2 * RANGE)


#: Matchers by the name an alias gives; others can be added, under any name without a colon. Those of these three names run as
#: expressions or batches in the relational form, any other row by row.
REGISTRY: dict[str, Callable[..., Diff]] = {
    EXACT: lambda q, p, downstream=no_term, token=no_term: exact_prefix(q, p, False, downstream),
    PREFIX: lambda q, p, downstream=no_term, token=no_term: exact_prefix(q, p, True, downstream),
    RELAXED: lambda q, p, downstream=no_term, token=no_term: levenshtein(q, p, downstream, token),
}


def match_string(query: str, prefix: str, matcher: Callable[..., Diff], **options) -> tuple[str, float, int, int, int]:
    """A matcher over the code points of two strings: (match, cost, leftmost, rightmost, alignments)."""
    diff = matcher(list(query), list(prefix), **options)
    return "".join(diff.match), diff.cost, diff.leftmost, diff.rightmost, diff.alignments


def score(prefix: Sequence, diff: Diff, downstream: Callable = no_term) -> tuple[float | None, int]:
    """(score, query terms covered). None where nothing matched; -1 where the match is too weak, or made of downstream
    terms only without covering all of the prefix."""
    length = diff.rightmost + 1
    if not diff.match:
        return None, length
    value = (length - diff.cost) / length if length > diff.cost else 1 / (length + diff.cost)
    value *= len(diff.common) / len(set(diff.match))
    value *= max(len(diff.match) - diff.leftmost, 0) / len(diff.match) * len(diff.match)
    if diff.common and all(map(downstream, diff.common)) and len(diff.common) != len(set(prefix)):
        return REJECTED, length
    return (REJECTED if value <= LOW else value), length


DIFF = T.StructType(
    [
        T.StructField("match", T.ArrayType(T.LongType())),
        T.StructField("cost", T.DoubleType()),
        T.StructField("leftmost", T.IntegerType()),
        T.StructField("rightmost", T.IntegerType()),
        T.StructField("alignments", T.IntegerType()),
        T.StructField("common", T.ArrayType(T.LongType())),
    ]
)


def flags_of(query: Column, downstream: Column) -> Column:
    """Flags of the query terms that an array of downstream terms holds."""
    return F.transform(query, lambda x: F.array_contains(downstream, x))


def exact_prefix_column(query: Column, prefix: Column, partial: Column | bool = False, downstream: Column | None = None, flags: Column | None = None) -> Column:
    """`exact_prefix` as a Spark expression over arrays; downstream terms come as terms or as flags of the query."""
    partial = F.lit(partial) if isinstance(partial, bool) else partial
    if downstream is not None:
        flags = flags_of(query, downstream)
    same_place = F.zip_with(F.slice(query, 1, F.size(prefix)), prefix, lambda a, b: F.coalesce(a == b, F.lit(False)))
    miss = F.array_position(same_place, False)
    run = F.when(miss > 0, miss - 1).otherwise(F.size(prefix)).cast("int")
    kept = run
    if flags is not None:
        # the last place within the run whose term isn't downstream
        places = F.filter(F.sequence(F.lit(0), F.size(query)), lambda i: (i >= 1) & (i <= run) & ~F.get(flags, i - 1))
        kept = F.coalesce(F.array_max(places), F.lit(0))
    size = F.when(run == F.size(prefix), run).when(partial, kept).otherwise(0)
    match = F.slice(query, F.lit(1), size)
    return F.struct(
        match.alias("match"),
        (F.size(prefix) - size).cast("double").alias("cost"),
        F.when(size > 0, 0).otherwise(-1).alias("leftmost"),
        (size - 1).cast("int").alias("rightmost"),
        size.cast("int").alias("alignments"),
        F.array_distinct(match).alias("common"),
    )


@F.arrow_udf(DIFF)
def _levenshtein(query: pa.Array, prefix: pa.Array, flags: pa.Array) -> pa.Array:
    n = len(query)
    numbers = {name: np.zeros(n, kind) for name, kind in (("cost", float), ("leftmost", np.int32), ("rightmost", np.int32), ("alignments", np.int32))}
    lists = {"match": [[]] * n, "common": [[]] * n}
    for rows, q, _, _, found in _aligned(query, prefix, flags):
        for name, own in numbers.items():
            own[rows] = getattr(found, name)
        for i, row in enumerate(rows.tolist()):
            lists["match"][row] = q[i][found.match[i]]
            lists["common"][row] = list(dict.fromkeys(q[i][found.common[i]][::-1].tolist()))
    columns = {**numbers, **lists}
    types = {f.name: t for f, t in zip(DIFF.fields, (pa.list_(pa.int64()), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())))}
    return pa.StructArray.from_arrays([pa.array(columns[name], kind) for name, kind in types.items()], list(types))


def levenshtein_column(query: Column | str, prefix: Column | str, downstream: Column | None = None, flags: Column | None = None) -> Column:
    """`levenshtein` over arrays of term hashes; numbers and token references are downstream in any case."""
    query, prefix = (F.col(x) if isinstance(x, str) else x for x in (query, prefix))
    if flags is None:
        terms = F.col(downstream) if isinstance(downstream, str) else downstream
        flags = flags_of(query, terms) if terms is not None else F.transform(query, lambda x: F.lit(False))
    return _levenshtein(query, prefix, flags)


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("length", T.IntegerType())])
#: Pairs that are aligned together.
TOGETHER = 100_000


def relaxed_scores(query: pa.Array, prefix: pa.Array, flags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scores, not a number where nothing matched, and lengths of the relaxed matcher over list arrays."""
    scores, lengths = np.full(len(query), np.nan), np.zeros(len(query), np.int32)
    for rows, q, p, down, found in _aligned(query, prefix, flags):
        scores[rows], lengths[rows] = score_alignments(q, p, found, down)
    return scores, lengths


def relaxed_matches(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, score, length) of the rows (keep, tail, prefix, flags) whose tail matches: batches are gathered up to TOGETHER
    pairs, so that many of equal lengths are aligned at once."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def scored(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting).combine_chunks()
        lists = (table.column(c).combine_chunks() for c in ("tail", "prefix", "flags"))
        scores, lengths = relaxed_scores(*lists)
        met = np.flatnonzero((scores > 0) & (lengths > 0))
        columns = [table.column(c).combine_chunks().take(pa.array(met)) for c in keep]
        return pa.RecordBatch.from_arrays([*columns, pa.array(scores[met]), pa.array(lengths[met])], names=[*keep, "score", "length"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= TOGETHER:
                yield scored(waiting)
                waiting = []
        if waiting:
            yield scored(waiting)

    return rows.select(*keep, "tail", "prefix", "flags").mapInArrow(match, f"{kinds}, score double, length int")


def registered_score_column(matcher: Column, query: Column, prefix: Column, flags: Column) -> Column:
    """Struct (score, length) by whatever matcher of the registry the row names, row by row."""
    known = dict(REGISTRY)

    def scores(matchers: pa.Array, queries: pa.Array, prefixes: pa.Array, below: pa.Array) -> pa.Array:
        out = []
        for name, q, p, f in zip(*(x.to_pylist() for x in (matchers, queries, prefixes, below))):
            down = {t for t, flag in zip(q, f) if flag}
            is_down = lambda t, down=down: t >= RANGE or t in down
            value, length = score(p, known[name](q, p, is_down, lambda t: t >= 2 * RANGE), is_down)
            out.append({"score": value, "length": length})
        return pa.array(out, pa.struct([("score", pa.float64()), ("length", pa.int32())]))

    return F.arrow_udf(scores, SCORED)(matcher, query, prefix, flags)


def match_string_column(query: Column | str, prefix: Column | str, matcher: str) -> Column:
    """A matcher over the code points of two strings: struct (match, cost, leftmost, rightmost, alignments)."""
    query, prefix = (F.col(x) if isinstance(x, str) else x for x in (query, prefix))
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    q, p = (F.transform(chars(x), lambda c: F.ascii(c).cast("bigint")) for x in (query, prefix))
    diff = levenshtein_column(q, p) if matcher == RELAXED else exact_prefix_column(q, p, matcher == PREFIX)
    text = F.array_join(F.transform(diff["match"], lambda code: F.get(chars(query), (F.array_position(q, code) - 1).cast("int"))), "")
    return F.struct(text.alias("match"), *(diff[c].alias(c) for c in ("cost", "leftmost", "rightmost", "alignments")))


def score_factors(diff: Column) -> Column:
    """The factors of a score: struct (match_factor, common_factor, position_factor, length_factor), for tracing."""
    length, size = diff["rightmost"] + 1, F.size(diff["match"])
    closeness = F.when(length > diff["cost"], F.try_divide(length - diff["cost"], length)).otherwise(F.try_divide(F.lit(1.0), length + diff["cost"]))
    return F.struct(
        closeness.alias("match_factor"),
        F.try_divide(F.size(diff["common"]), F.size(F.array_distinct(diff["match"]))).alias("common_factor"),
        F.try_divide(F.greatest(size - diff["leftmost"], F.lit(0)), size).alias("position_factor"),
        size.alias("length_factor"),
    )


def score_column(diff: Column, prefix: Column, downstream: Column | None = None, query: Column | None = None, flags: Column | None = None) -> Column:
    """`score` as a Spark expression: struct (score, length); score is null where nothing matched. Downstream terms come as
    terms, or as flags of the query."""
    factors = score_factors(diff)
    value = factors["match_factor"] * factors["common_factor"] * factors["position_factor"] * factors["length_factor"]
    weak = value <= LOW
    if downstream is not None or flags is not None:
        known = lambda t: F.array_contains(downstream, t) if flags is None else F.get(flags, (F.array_position(query, t) - 1).cast("int"))
        below = F.forall(diff["common"], lambda t: (t >= RANGE) | known(t))
        weak = weak | ((F.size(diff["common"]) > 0) & below & (F.size(diff["common"]) != F.size(F.array_distinct(prefix))))
    scored = F.when(F.size(diff["match"]) > 0, F.when(weak, REJECTED).otherwise(value))
    return F.struct(scored.cast("double").alias("score"), (diff["rightmost"] + 1).cast("int").alias("length"))
