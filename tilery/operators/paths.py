"""Paths through utterance graphs: all, and those of the greatest score; paths as token spans.

An utterance of n terms has n + 1 boundaries; an edge leads from its start over its length. Graphs are small and
independent, so a row holds one and is solved by itself; nothing is exchanged between rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilery.functions.matchers import align, groups, no_term, score_alignments
from tilery.operators.edges import edge_lists
from tilery.schemas import EDGE

Edge = tuple[float, int, int]
PATHS = T.ArrayType(T.ArrayType(EDGE))


def _trace(back: list[dict[tuple[int, int], Edge]], at: int) -> Iterator[list[Edge]]:
    """Paths from 0 to a boundary, by the order in which its back links were made; without recursion."""
    stack = [(at, None)]
    while stack:
        vertex, tail = stack.pop()
        if vertex == 0:
            path, link = [], tail
            while link is not None:
                path.append(link[0])
                link = link[1]
            yield path
            continue
        # a vertex met again from the same boundary keeps together with its first link
        starts = list(dict.fromkeys(start for start, _ in back[vertex]))
        links = [(start, edge) for start in starts for (s, _), edge in back[vertex].items() if s == start]
        for start, edge in reversed(links):
            stack.append((start, (edge, tail)))


def all_paths(edge_lists: list[list[Edge]]) -> Iterator[list[Edge]]:
    """Every path from start to end. Of edges with the same boundaries and token the last counts; edges beyond the end
    or of no length don't. Where the end can't be reached there is no path."""
    n = len(edge_lists)
    back: list[dict] = [{} for _ in range(n + 1)]
    reached = [True] + [False] * n
    for start, edges in enumerate(edge_lists):
        if reached[start]:
            for edge in edges:
                end = start + edge[1]
                if edge[1] > 0 and end <= n:
                    back[end][start, edge[2]] = edge
                    reached[end] = True
    return _trace(back, n) if n and reached[n] else iter(())


def maximal_paths(edge_lists: list[list[Edge]]) -> Iterator[list[Edge]]:
    """Every path of the greatest sum of scores, summed from the left; equal sums all count."""
    n = len(edge_lists)
    back: list[dict] = [{} for _ in range(n + 1)]
    best: list[float | None] = [0.0] + [None] * n
    for start, edges in enumerate(edge_lists):
        if best[start] is None:
            continue
        for edge in edges:
            end = start + edge[1]
            if edge[1] <= 0 or end > n or edge[0] is None or edge[0] != edge[0]:
                continue
            total = best[start] + edge[0]
            if best[end] is None or total > best[end]:
                best[end], back[end] = total, {(start, edge[2]): edge}
            elif total == best[end]:
                back[end][start, edge[2]] = edge
    return _trace(back, n) if n and best[n] is not None else iter(())


def some_path_reads(edge_lists: list[list[Edge]], text_of: Callable[[Edge, int], str], wanted: list[str]) -> bool:
    """Whether the edges of some path read as the wanted texts in order; text_of takes an edge and its start.

    Places are pairs of a boundary and of how much has been read, so this is linear in edges times texts."""
    n = len(edge_lists)
    read: list[set[int]] = [set() for _ in range(n + 1)]
    read[0].add(0)
    for start, edges in enumerate(edge_lists):
        if not read[start]:
            continue
        for edge in edges:
            if 0 < edge[1] <= n - start:
                text = text_of(edge, start)
                read[start + edge[1]].update(i + 1 for i in read[start] if i < len(wanted) and wanted[i] == text)
    return len(wanted) in read[n]


def _walks(edge_lists: list[list[Edge]], start: int) -> Iterator[tuple[list[int], list[int]]]:
    """(token ids, boundaries) of every path from a boundary that can't be continued."""
    stack: list[tuple[int, list[int], list[int]]] = [(start, [], [start])]
    while stack:
        at, terms, ends = stack.pop()
        onward = [e for e in edge_lists[at] if 0 < e[1] <= len(edge_lists) - at] if at < len(edge_lists) else []
        for edge in onward:
            stack.append((at + edge[1], [*terms, edge[2]], [*ends, at + edge[1]]))
        if terms and not onward:
            yield terms, ends


def lattices_matches(lattices: Iterable[tuple[list[list[Edge]], int, list[int]]], downstream: Callable = no_term, token: Callable = no_term) -> list[dict[int, float]]:
    """Of each lattice (edge lists, boundary, prefix) the best score of the prefix along the paths from the boundary, by the
    boundary that the match reaches.

    The terms of a path are the token ids of its edges; paths are aligned by edit distance, those of equal lengths together."""
    best: list[dict[int, float]] = []
    jobs: list[tuple[int, list[int], list[int], list[int]]] = []
    for edge_lists, start, prefix in lattices:
        jobs += [(len(best), terms, ends, prefix) for terms, ends in _walks(edge_lists, start)]
        best.append({})
    if not jobs:
        return best
    for rows in groups(np.array([len(j[1]) for j in jobs]), np.array([len(j[3]) for j in jobs])):
        own = [jobs[i] for i in rows.tolist()]
        q, p = np.array([j[1] for j in own], np.int64), np.array([j[3] for j in own], np.int64).reshape(len(own), -1)
        down, fixed = (np.array([[bool(f(x)) for x in j[1]] for j in own], bool) for f in (downstream, token))
        values, lengths = score_alignments(q, p, align(q[:, :, None] == p[:, None, :], down, fixed), down)
        for (at, _, ends, _), value, length in zip(own, values.tolist(), lengths.tolist()):
            if value > 0:
                best[at][ends[length]] = max(value, best[at].get(ends[length], value))
    return best


def lattice_matches(edge_lists: list[list[Edge]], start: int, prefix: list[int], downstream: Callable = no_term, token: Callable = no_term) -> dict[int, float]:
    """`lattices_matches` of one lattice."""
    return lattices_matches([(edge_lists, start, prefix)], downstream, token)[0]


def _edges(graphs: pa.Array) -> Iterator[list[list[Edge]]]:
    """The edge lists of each graph, read from the flat children of the array; null lists are empty."""
    lists = graphs.flatten()
    flat = lists.flatten()
    score, length, token = (flat.field(name).to_numpy(zero_copy_only=False).tolist() for name in ("score", "length", "token_id"))
    edges = list(zip(score, length, token))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    ends = np.append(0, np.cumsum(sizes)).tolist()
    rows = [edges[a:b] for a, b in zip(ends, ends[1:])]
    at = 0
    for n in np.asarray(pc.fill_null(pc.list_value_length(graphs), 0)).tolist():
        yield rows[at : at + n]
        at += n


def _solver(solve, most: int | None):
    def rows(graphs: pa.Array) -> pa.Array:
        paths, sizes, flat = [], [], []
        for lists in _edges(graphs):
            own = list(islice(solve(lists), most))
            paths.append(len(own))
            for path in own:
                sizes.append(len(path))
                flat += path
        columns = list(zip(*flat)) or [(), (), ()]
        kinds = (pa.float64(), pa.int32(), pa.int64())
        structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["score", "length", "token_id"])
        offsets = lambda counts: pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets(paths), pa.ListArray.from_arrays(offsets(sizes), structs))

    return F.arrow_udf(rows, PATHS)


def all_paths_column(edge_lists: Column | str, most: int | None = None) -> Column:
    """All paths of a graph in order; `most` bounds them where a caller wants only the first."""
    return _solver(all_paths, most)(edge_lists)


def maximal_paths_column(edge_lists: Column | str, most: int | None = None) -> Column:
    return _solver(maximal_paths, most)(edge_lists)


def path_rows(graphs: DataFrame, paths: Column) -> DataFrame:
    """(query_id, path_id, path, score): a row for each path."""
    rows = graphs.select("query_id", F.posexplode(paths).alias("path_id", "path"))
    return rows.withColumn("score", F.aggregate("path", F.lit(0.0), lambda acc, e: acc + e["score"]))


def spans(path: Column) -> Column:
    """The edges of a path as token spans, each with its start."""
    starts = F.aggregate(path, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + e["length"])))
    return F.zip_with(
        path, F.slice(starts, F.lit(1), F.size(path)),
        lambda e, s: F.struct(e["token_id"].alias("token_id"), s.alias("start"), e["length"].alias("length"), e["score"].alias("score")),
    )


def add_edges(edges: DataFrame) -> DataFrame:
    """(from, to, token, score): the best score of each edge of a graph given by its boundaries."""
    return edges.groupBy("from", "to", "token").agg(F.max("score").alias("score"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """(to, in_degree): distinct edges into each boundary."""
    return add_edges(edges).groupBy("to").agg(F.count("*").alias("in_degree"))


def vertex_counts(edges: DataFrame, key: str) -> DataFrame:
    """(key, vertices): distinct boundaries that the edges of each graph touch."""
    touched = edges.select(key, F.explode(F.array("from", "to")).alias("__v")).distinct()
    return touched.groupBy(key).agg(F.count("*").alias("vertices"))


def boundary_lists(edges: DataFrame, key: str) -> DataFrame:
    """(query_id, edge_lists) of graphs (key, from, to, token, score) by their boundaries from 0 to the last one any edge
    touches: the best of equal edges, best first, then by token. Edges that don't lead forward are on no path."""
    best = edges.groupBy(F.col(key).alias("query_id"), "from", "to", "token").agg(F.max("score").alias("score"))
    sizes = best.groupBy("query_id").agg(F.greatest(F.max("from"), F.max("to")).cast("int").alias("n"))
    rows = best.select(
        "query_id", F.col("from").cast("int").alias("start"), F.col("token").cast("bigint").alias("ord"), F.col("score").cast("double").alias("score"),
        (F.col("to") - F.col("from")).cast("int").alias("length"), F.col("token").cast("bigint").alias("token_id"),
    )
    return edge_lists(rows, sizes)


def is_dag(edges: DataFrame, key: str) -> DataFrame:
    """(key, dag): whether the vertices of each graph (key, from, to) have a topological order, by taking away vertices
    without edges into them until none is left. What a row gathers are the distinct edges of one graph."""
    links = edges.groupBy(key).agg(F.collect_set(F.struct(F.col("from").cast("bigint").alias("f"), F.col("to").cast("bigint").alias("t"))).alias("__links"))

    def ordered(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        starts, ends = (flat.field(c).to_pylist() for c in ("f", "t"))
        cuts = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists)))).tolist()
        return pa.array([_acyclic(list(zip(starts[a:b], ends[a:b]))) for a, b in zip(cuts, cuts[1:])], pa.bool_())

    return links.select(key, F.arrow_udf(ordered, T.BooleanType())("__links").alias("dag"))


def _acyclic(links: list[tuple[int, int]]) -> bool:
    onward: dict[int, list[int]] = {}
    into = dict.fromkeys((v for link in links for v in link), 0)
    for start, end in links:
        onward.setdefault(start, []).append(end)
        into[end] += 1
    free, left = [v for v, n in into.items() if not n], len(into)
    while free:
        left -= 1
        for end in onward.get(free.pop(), ()):
            into[end] -= 1
            if not into[end]:
                free.append(end)
    return not left


def lattice_matches_column(edge_lists: Column | str, start: Column, prefix: Column) -> Column:
    """`lattice_matches` of the graph of each row: structs (end, score)."""

    def rows(graphs: pa.Array, starts: pa.Array, prefixes: pa.Array) -> pa.Array:
        found = lattices_matches(zip(_edges(graphs), starts.to_pylist(), prefixes.to_pylist()))
        out = [[{"end": end, "score": value} for end, value in sorted(own.items())] for own in found]
        return pa.array(out, pa.list_(pa.struct([("end", pa.int32()), ("score", pa.float64())])))

    kind = T.ArrayType(T.StructType([T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    # else a filter on its size could be put where only expressions run
    return F.arrow_udf(rows, kind).asNondeterministic()(edge_lists, start, prefix)
