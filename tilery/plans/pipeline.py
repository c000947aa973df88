"""Utterances to tokens: the relational form, and the row-local form.

Both give the first path of the greatest score. The relational form joins positions with postings and suits an
index of any size. The row-local form solves the utterances of a batch where they stand, against an index sent to every
task, whose size is checked; it shuffles nothing and serves streams as well. `tile` and `accepts` take the local form for an
index that it can hold, else the relational one.

Numbers are read by `numbers`, a function from the terms' hashes to (value, terms counted); by default the grammar of the
lexicon's number words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilery.functions.formatting import token_text
from tilery.functions.matchers import REGISTRY, RELAXED, align, groups, score, score_alignments
from tilery.functions.terms import RANGE, TermModel, hash_stem, stem_term
from tilery.operators.edges import edge_lists, known_postings, match_edges, number_edges, tails, union_edges, unknown_edges
from tilery.operators.lexicon import Lexicon, hashed
from tilery.operators.paths import maximal_paths, maximal_paths_column, path_rows, some_path_reads, spans
from tilery.schemas import NUMBER_BASE, UNKNOWN_ID

#: Aliases that the row-local form takes; more need the relational form.
MAX_LOCAL_ALIASES = 1_000_000
#: Words whose hash a worker remembers.
KEEP_WORDS = 500_000

Numbers = Callable[[list], list[tuple[int, int]]]
_SPANS = "array<struct<token_id:bigint,start:int,length:int,score:double>>"


def token_table(lexicon: Lexicon, kinds: dict[str, str]) -> DataFrame:
    """(token_id, type, pid, name, value): the token of every alias; `kinds` names the token type of each domain. The pid
    of a quantifier is its value."""
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("domain")]
    return lexicon.aliases.select(F.col("alias_id").alias("token_id"), kind.alias("type"), "pid", "name", F.col("pid").cast("double").alias("value"))


def token_texts(lexicon: Lexicon, kinds: dict[str, str]) -> DataFrame:
    """(token_id, token_text) of every alias."""
    text = token_text(F.col("type"), F.col("pid"), F.col("name"), F.col("value"), F.lit(None).cast("string"))
    return token_table(lexicon, kinds).select("token_id", text.alias("token_text"))


@dataclass
class LocalIndex:
    """What one task needs to solve utterances: plain dictionaries."""

    postings: dict[int, list[int]]
    aliases: dict[int, tuple[list[int], str, str]]
    downstream: dict[str, frozenset]
    model: TermModel
    numbers: Numbers

    def graphs(self, utterances: list[list[int]]) -> list[list[list[tuple[float, int, int]]]]:
        """Edge lists of utterances as hashes, best first; equal scores as unknown, postings, numbers.

        The relaxed matches of all utterances are aligned together."""
        found: list[list[list[tuple[int, float, int]]]] = [[[] for _ in said] for said in utterances]
        flags: dict[tuple[int, str], list[bool]] = {}
        waiting: list[tuple[int, int, int]] = []
        for u, said in enumerate(utterances):
            for start, own in enumerate(said):
                aliases = self.postings.get(own, ())
                ahead = set(said[start:]) if aliases else set()
                for alias in aliases:
                    prefix, matcher, domain = self.aliases[alias]
                    below = self.downstream[domain]
                    if (u, domain) not in flags:
                        flags[u, domain] = [x >= RANGE or x in below for x in said]
                    # whatever is aligned is among these terms: downstream terms only, and not all, are always rejected
                    wanted = set(prefix)
                    shared = wanted & ahead
                    if len(shared) < len(wanted) and all(x >= RANGE or x in below for x in shared):
                        continue
                    if matcher == RELAXED:
                        waiting.append((u, start, alias))
                        continue
                    down = lambda x, below=below: x >= RANGE or x in below
                    value, length = score(prefix, REGISTRY[matcher](said[start:], prefix, down, lambda x: x >= 2 * RANGE), down)
                    if value is not None and value > 0 and length > 0:
                        found[u][start].append((alias, value, length))
        if waiting:
            width = np.array([len(utterances[u]) - start for u, start, _ in waiting])
            height = np.array([len(self.aliases[alias][0]) for *_, alias in waiting])
            for rows in groups(width, height):
                own = [waiting[i] for i in rows.tolist()]
                q, p = np.array([utterances[u][start:] for u, start, _ in own]), np.array([self.aliases[alias][0] for *_, alias in own])
                down = np.array([flags[u, self.aliases[alias][2]][start:] for u, start, alias in own])
                values, lengths = score_alignments(q, p, align(q[:, :, None] == p[:, None, :], down, q >= 2 * RANGE), down)
                for (u, start, alias), value, length in zip(own, values.tolist(), lengths.tolist()):
                    if value > 0 and length > 0:
                        found[u][start].append((alias, value, length))
        out = []
        for said, places in zip(utterances, found):
            graph = []
            for start, met in enumerate(places):
                row = [(0.0, 1, UNKNOWN_ID), *((value, length, alias) for alias, value, length in sorted(met))]
                row += [(float(length), length, NUMBER_BASE - value) for value, length in self.numbers(said[start:])]
                row.sort(key=lambda e: -e[0])
                graph.append(row)
            out.append(graph)
        return out

    def hasher(self) -> Callable[[str], int]:
        known: dict[str, int] = {}

        def of(word: str) -> int:
            if word not in known:
                if len(known) >= KEEP_WORDS:
                    known.clear()
                known[word] = hash_stem(stem_term(word, self.model.stemmer))
            return known[word]

        return of


def is_local(lexicon: Lexicon, most: int | None = None) -> bool:
    """Whether the row-local form can hold the lexicon: few enough aliases, a stemmer in Python, breaks at white space."""
    plain = lexicon.model.column_stemmer is None and lexicon.model.breaker is None
    return plain and lexicon.aliases.limit((MAX_LOCAL_ALIASES if most is None else most) + 1).count() <= (MAX_LOCAL_ALIASES if most is None else most)


def local_index(lexicon: Lexicon, numbers: Numbers | None = None) -> LocalIndex:
    if not is_local(lexicon):
        raise ValueError(f"the row-local form takes at most {MAX_LOCAL_ALIASES} aliases, Python stemmers, and breaks at white space")
    aliases = {r[0]: (list(r[1]), r[2], r[3]) for r in lexicon.aliases.select("alias_id", "hashes", "matcher", "domain").collect()}
    downstream: dict[str, set] = {domain: set() for _, _, domain in aliases.values()}
    for domain, own in lexicon.downstream().collect():
        downstream.setdefault(domain, set()).add(own)
    postings: dict[int, list[int]] = {}
    for alias in sorted(aliases):
        for own in dict.fromkeys(aliases[alias][0]):
            postings.setdefault(own, []).append(alias)
    return LocalIndex(postings, aliases, {k: frozenset(v) for k, v in downstream.items()}, lexicon.model, numbers or lexicon.numbers())


def tile_local(utterances: DataFrame, key: str, text: str, lexicon: Lexicon, numbers: Numbers | None = None) -> DataFrame:
    """(key, words, tokens) of every utterance with a text: one narrow pass."""
    kind = utterances.schema[key].dataType.simpleString()
    shared = utterances.sparkSession.sparkContext.broadcast(cloudpickle.dumps(local_index(lexicon, numbers)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: LocalIndex = cloudpickle.loads(shared.value)
        of = index.hasher()
        for batch in batches:
            words = [said.split() for said in batch.column("text").to_pylist()]
            tokens_out = []
            for graph in index.graphs([[of(w) for w in own] for own in words]):
                start, tokens = 0, []
                for value, length, token in next(maximal_paths(graph), []):
                    tokens.append({"token_id": token, "start": start, "length": length, "score": value})
                    start += length
                tokens_out.append(tokens)
            spans_type = pa.list_(pa.struct([("token_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(words, pa.list_(pa.string())), pa.array(tokens_out, spans_type)], names=["key", "words", "tokens"]
            )

    source = utterances.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return source.mapInArrow(solve, f"key {kind}, words array<string>, tokens {_SPANS}").withColumnRenamed("key", key)


def graphs_relational(utterances: DataFrame, key: str, text: str, lexicon: Lexicon, numbers: Numbers | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, terms) and (query_id, edge_lists) of every utterance with a text, by joins."""
    source = utterances.select(F.col(key).alias("query_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    arrays = hashed(source, ["query_id"], "text", lexicon.model, lexicon.below())
    positions = tails(arrays)
    matches = match_edges(positions, known_postings(lexicon.posting_rows().distinct(), lexicon.aliases))
    edges = union_edges(unknown_edges(positions), matches, number_edges(arrays, "hashes", numbers or lexicon.numbers()))
    return arrays.select("query_id", "terms"), edge_lists(edges, arrays.select("query_id", F.size("terms").alias("n")))


def tile_relational(utterances: DataFrame, key: str, text: str, lexicon: Lexicon, numbers: Numbers | None = None) -> DataFrame:
    """(key, words, tokens), by joins."""
    words, graphs = graphs_relational(utterances, key, text, lexicon, numbers)
    first = path_rows(graphs, maximal_paths_column("edge_lists", 1)).select("query_id", spans(F.col("path")).alias("tokens"))
    return words.join(first, "query_id").select(F.col("query_id").alias(key), F.col("terms").alias("words"), F.col("tokens").cast(_SPANS))


def tile(utterances: DataFrame, key: str, text: str, lexicon: Lexicon, numbers: Numbers | None = None, most: int | None = None) -> DataFrame:
    """(key, words, tokens), by the form that suits the index."""
    return (tile_local if is_local(lexicon, most) else tile_relational)(utterances, key, text, lexicon, numbers)


def _reads_as(known: dict[int, str], words: list[str]) -> Callable:
    def reads(edge: tuple[float, int, int], start: int) -> str:
        if edge[2] == UNKNOWN_ID:
            return f"[WORD:{words[start].upper()}]"
        return known[edge[2]] if edge[2] >= 0 else f"[NUMBER:{NUMBER_BASE - edge[2]}]"

    return reads


def accepts_local(tests: DataFrame, key: str, text: str, expected: str, lexicon: Lexicon, kinds: dict[str, str]) -> DataFrame:
    """(key, passed): whether some path of each utterance's graph, not just the best, reads as the expected token texts
    (an array). Utterances without a text or an expectation don't pass."""
    kind = tests.schema[key].dataType.simpleString()
    index = local_index(lexicon)  # checks the size of what is gathered here
    texts = {r[0]: r[1] for r in token_texts(lexicon, kinds).collect()}
    shared = tests.sparkSession.sparkContext.broadcast(cloudpickle.dumps((index, texts)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = cloudpickle.loads(shared.value)
        of = index.hasher()
        for batch in batches:
            words = [said.split() if said else [] for said in batch.column("text").to_pylist()]
            graphs = index.graphs([[of(w) for w in own] for own in words])
            passed = [
                bool(own) and wanted is not None and some_path_reads(graph, _reads_as(known, own), wanted)
                for own, graph, wanted in zip(words, graphs, batch.column("expected").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(passed, pa.bool_())], names=["key", "passed"])

    source = tests.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(expected).alias("expected"))
    return source.mapInArrow(solve, f"key {kind}, passed boolean").withColumnRenamed("key", key)


def accepts_relational(tests: DataFrame, key: str, text: str, expected: str, lexicon: Lexicon, kinds: dict[str, str]) -> DataFrame:
    """`accepts_local` by joins; the texts of a graph's tokens are joined to it."""
    words, graphs = graphs_relational(tests, key, text, lexicon)
    used = graphs.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("edge_lists", lambda row: F.transform(row, lambda e: e["token_id"]))))).alias("token_id"))
    named = used.join(token_texts(lexicon, kinds), "token_id").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("token_id", "token_text"))).alias("texts"))

    def judge(graph: pa.Array, texts: pa.Array, terms: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for lists, known, own, want in zip(graph.to_pylist(), texts.to_pylist(), terms.to_pylist(), wanted.to_pylist()):
            edges = [[(e["score"], e["length"], e["token_id"]) for e in row] for row in lists]
            out.append(want is not None and some_path_reads(edges, _reads_as(dict(known or ()), own), want))
        return pa.array(out, pa.bool_())

    rows = graphs.join(words, "query_id").join(named, "query_id", "left").join(tests.select(F.col(key).alias("query_id"), F.col(expected).alias("wanted")), "query_id")
    judged = rows.select("query_id", F.arrow_udf(judge, "boolean")("edge_lists", "texts", "terms", "wanted").alias("passed"))
    all_tests = tests.select(F.col(key).alias("query_id"))
    return all_tests.join(judged, "query_id", "left").select(F.col("query_id").alias(key), F.coalesce("passed", F.lit(False)).alias("passed"))


def accepts(tests: DataFrame, key: str, text: str, expected: str, lexicon: Lexicon, kinds: dict[str, str], most: int | None = None) -> DataFrame:
    """(key, passed), by the form that suits the index."""
    return (accepts_local if is_local(lexicon, most) else accepts_relational)(tests, key, text, expected, lexicon, kinds)


def token_strings(tiled: DataFrame, key: str, tokens: DataFrame) -> DataFrame:
    """(key, observed): the tokens of each utterance as texts, joined by blanks. A term of no meaning is a WORD of the
    raw terms it spans."""
    rows = tiled.select(key, "words", F.posexplode("tokens").alias("at", "t"))
    rows = rows.select(key, "words", "at", "t.*").join(tokens, "token_id", "left")
    number = F.col("token_id") <= NUMBER_BASE
    kind = F.when(number, "NUMBER").when(F.col("token_id") == UNKNOWN_ID, "WORD").otherwise(F.col("type"))
    value = F.when(number, (F.lit(NUMBER_BASE) - F.col("token_id")).cast("double")).otherwise(F.col("value"))
    raw = F.upper(F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), "_"))
    texts = rows.select(key, "at", token_text(kind, F.col("pid"), F.col("name"), value, raw).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    return texts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("observed"))
