"""Edges of utterance graphs: candidates from the index, scored matches, numbers, unknown terms; filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilery.functions.matchers import EXACT, PREFIX, REGISTRY, RELAXED, exact_prefix_column, levenshtein_column, registered_score_column, relaxed_matches, score_column, score_factors
from tilery.functions.numbers import NumberGrammar, number_matches
from tilery.functions.terms import RANGE, decode
from tilery.plans.session import shuffle_partitions
from tilery.schemas import NUMBER_BASE, UNKNOWN_ID

_EDGE = ("query_id", "start", "ord", "score", "length", "token_id")


def tails(utterances: DataFrame) -> DataFrame:
    """(query_id, start, hash, tail) for every position of utterances (query_id, hashes); with `below`, the domains each term
    is downstream of, also its tail, below_tail."""
    names = [("hashes", "tail")] + [("below", "below_tail")] * ("below" in utterances.columns)
    at = utterances.select("query_id", *(c for c, _ in names), F.posexplode("hashes").alias("start", "hash"))
    return at.select("query_id", "start", "hash", *(F.slice(c, F.col("start") + 1, F.size(c)).alias(tail) for c, tail in names))


def candidates(positions: DataFrame, postings: DataFrame) -> DataFrame:
    """Each position with each occurrence (hash, alias_id, and what else is known of it) of its term in an alias.

    An equi-join on the hash: Spark broadcasts postings that are small enough by their size, and splits hot hashes
    of large ones at run time; no list of them is ever held in a row."""
    return positions.join(postings, "hash")


def known_postings(postings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(hash, alias_id, domain, matcher, prefix): occurrences of terms with what their alias matches, and how."""
    return postings.join(aliases.select("alias_id", "domain", "matcher", F.col("hashes").alias("prefix")), "alias_id")


def match_edges(positions: DataFrame, postings: DataFrame) -> DataFrame:
    """Scored edges of positions and the known postings of their terms: matched by the alias's own matcher, without empty and
    rejected matches.

    Which terms are downstream comes as one flag a term. Each matcher meets the postings of its own aliases only."""
    told = F.transform("below_tail", lambda domains: F.array_contains(domains, F.col("domain")))
    of = lambda *matchers: candidates(positions, postings.where(F.col("matcher").isin(*matchers))).withColumn("flags", told)
    key = ["query_id", "start", "alias_id"]
    tail, prefix, flags = F.col("tail"), F.col("prefix"), F.col("flags")
    diff = exact_prefix_column(tail, prefix, F.col("matcher") == PREFIX, flags=F.zip_with(flags, tail, lambda f, t: f | (t >= RANGE)))
    by_place = of(EXACT, PREFIX).withColumn("diff", diff)
    by_place = by_place.withColumn("s", score_column(F.col("diff"), prefix, query=tail, flags=flags)).drop("diff")
    both = by_place.select(*key, "s.score", "s.length")
    both = both.unionByName(relaxed_matches(of(RELAXED), key))
    if others := [m for m in REGISTRY if m not in (EXACT, PREFIX, RELAXED)]:
        own = of(*others).withColumn("s", registered_score_column(F.col("matcher"), tail, prefix, flags))
        both = both.unionByName(own.select(*key, "s.score", "s.length"))
    scored = both.select("query_id", "start", (F.col("alias_id") + 1).alias("ord"), "score", "length", F.col("alias_id").alias("token_id"))
    return scored.where((F.col("score") > 0) & (F.col("length") > 0))


def trace_matches(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, start, alias_id, query, prefix, match, match_factor, common_factor, position_factor, length_factor) of every
    candidate (a position with a known posting) of the exact, prefix and relaxed matchers: what was matched with what, decoded by
    (hash, text), and why it scores as it does."""
    rows = found.withColumn("flags", F.transform("below_tail", lambda domains: F.array_contains(domains, F.col("domain"))))
    tail, prefix, flags = F.col("tail"), F.col("prefix"), F.col("flags")
    by_place = exact_prefix_column(tail, prefix, F.col("matcher") == PREFIX, flags=F.zip_with(flags, tail, lambda f, t: f | (t >= RANGE)))
    columns = ["query_id", "start", "alias_id", "tail", "prefix"]
    traced = rows.where(F.col("matcher").isin(EXACT, PREFIX)).select(*columns, by_place.alias("diff"))
    relaxed = rows.where(F.col("matcher") == RELAXED).select(*columns, levenshtein_column("tail", "prefix", flags=flags).alias("diff"))
    traced = traced.unionByName(relaxed).select(*columns, F.col("diff.match").alias("match"), score_factors(F.col("diff")).alias("factors"))
    key = ["query_id", "start", "alias_id"]
    out = traced.select(*key, "factors.*")
    for name, source in (("query", "tail"), ("prefix", "prefix"), ("match", "match")):
        out = out.join(decoded(traced.select(*key, F.col(source).alias(name)), key, name, texts), key, "left")
    factors = ("match_factor", "common_factor", "position_factor", "length_factor")
    return out.select(*key, *(F.coalesce(c, F.lit("")).alias(c) for c in ("query", "prefix", "match")), *factors)


def decoded(rows: DataFrame, key: list[str], lists: str, texts: DataFrame) -> DataFrame:
    """(key, lists): each list of hashes as one text, by (hash, text); unknown hashes are marked. Distinct rows of the key; empty
    lists have no row."""
    at = rows.select(*key, F.posexplode(lists).alias("__place", "hash"))
    named = at.join(texts, "hash", "left").withColumn("text", decode(F.col("hash"), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("__place", "text")))
    return named.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias(lists))


def unknown_edges(positions: DataFrame) -> DataFrame:
    """The edge of no meaning at every position: score 0, one term."""
    return positions.select(
        "query_id", "start", F.lit(0).cast("bigint").alias("ord"), F.lit(0.0).alias("score"), F.lit(1).alias("length"), F.lit(UNKNOWN_ID).cast("bigint").alias("token_id")
    )


def number_edges(utterances: DataFrame, terms: str = "words", grammar: NumberGrammar | None = None) -> DataFrame:
    """Edges of all numbers at every position of (query_id, terms): the score is the number of terms. The grammar reads the
    terms; only tails that begin as a number can go to it."""
    grammar = grammar or NumberGrammar()
    at = utterances.select("query_id", terms, F.posexplode(terms).alias("start", "term"))
    first = getattr(grammar, "first", None)
    at = at.where(F.col("term").isin(*first)) if first else at
    at = at.select("query_id", "start", number_matches(F.slice(terms, F.col("start") + 1, F.size(terms)), grammar).alias("found"))
    rows = at.select("query_id", "start", F.posexplode("found").alias("place", "m"))
    return rows.select(
        "query_id", "start", (F.lit(1 << 40) + F.col("place")).alias("ord"), F.col("m.length").cast("double").alias("score"),
        F.col("m.length").alias("length"), (F.lit(NUMBER_BASE) - F.col("m.value")).alias("token_id"),
    )


def union_edges(*edges: DataFrame) -> DataFrame:
    out = edges[0].select(*_EDGE)
    for other in edges[1:]:
        out = out.unionByName(other.select(*_EDGE))
    return out


def filter_edges(edges: DataFrame, threshold: float | Column) -> DataFrame:
    """Edges of at least the threshold, and all unknown ones; scores that are no numbers go."""
    strong = ~F.isnan("score") & F.col("score").isNotNull() & (F.col("score") >= threshold)
    return edges.where(strong | (F.col("token_id") == UNKNOWN_ID))


def coalesce_edges(edges: DataFrame, by: str = "token_id") -> DataFrame:
    """The best edge of each position, token and length; the first of equals."""
    best = Window.partitionBy("query_id", "start", by, "length").orderBy(F.desc("score"), "ord")
    return edges.withColumn("__n", F.row_number().over(best)).where(F.col("__n") == 1).drop("__n")


def edge_lists(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, edge_lists): for every utterance (query_id, n) an array over its positions of edges, best first.

    What is gathered in a row are the edges of one utterance."""
    usable = edges.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("length") > 0) & (F.col("start") >= 0))
    # all that follows is by utterance, so one shuffle does; solving graphs is dear for its bytes
    usable = usable.repartition(shuffle_partitions(edges.sparkSession), "query_id")
    entry = F.struct("start", (-F.col("score")).alias("worst"), "ord", "score", "length", "token_id")
    lists = usable.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    plain = lambda x: F.struct(x["score"].alias("score"), x["length"].alias("length"), x["token_id"].alias("token_id"))
    none = F.array().cast("array<struct<score:double,length:int,token_id:bigint>>")
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    # edges of a place stand together, so each list is a slice
    counts = F.transform(places, lambda i: F.coalesce(F.size(F.filter("all", lambda e: e["start"] == i)), F.lit(0)))
    ends = F.aggregate("counts", F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c)))
    row = F.zip_with("counts", F.slice("ends", F.lit(1), F.size("counts")), lambda c, e: F.when(c > 0, F.transform(F.slice("all", e + 1, c), plain)).otherwise(none))
    return sizes.join(lists, "query_id", "left").withColumn("counts", counts).withColumn("ends", ends).select("query_id", row.alias("edge_lists"))
