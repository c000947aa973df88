"""Queries of the utterance engine over the test tables, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilery.functions.formatting import label_form, token_text
from tilery.functions.matchers import exact_prefix_column, score_column, score_factors
from tilery.functions.speech import speech_text
from tilery.functions.terms import TermModel, decode, dictionary, hash_of_stem, is_number_hash, is_token_hash, number_hash, strip_plural, word_break
from tilery.operators import edges as E
from tilery.operators import lexicon as L
from tilery.operators import paths as P
from tilery.operators import relevance as R
from tilery.operators.expand import alias_matcher, alias_pattern, expand_pattern
from tilery.operators.numbering import number_rows
from tilery.operators.packed import BRACKETED, SEPARATED, split_packed
from tilery.plans import pipeline, shop
from tilery.plans.packed_queries import _VALUES
from tilery.plans.session import shuffle_partitions, table
from tilery.sources.catalog import last_wins

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _c(name: str):
    return F.col(name)


# --- terms -----------------------------------------------------------------------------------------------------------

_DOC_WORDS = r"(SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS term FROM documents)"


@query(
    r"""SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS term FROM
    (SELECT item_id, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT item_id, string_split_regex(text, '\s+') AS w FROM eval_items))"""
)
def word_break_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, pos, term): terms of every text, empty ones at its ends included."""
    return table(spark, sf_dir, "eval_items").select("item_id", F.posexplode(word_break(_c("text"))).alias("pos", "term"))


@query(f"SELECT regexp_replace(lower(term), 's$', '') AS stem, count(*) AS frequency, count(DISTINCT doc_id) AS docs FROM {_DOC_WORDS} WHERE term <> '' GROUP BY 1")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, frequency, docs) of the words of all documents. Counts of a document's stem come first, so the distinct
    count of documents needs no second pass."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(word_break(_c("text"))).alias("term")).where("term <> ''")
    own = words.groupBy(strip_plural(_c("term")).alias("stem"), "doc_id").agg(F.count("*").alias("n"))
    return own.groupBy("stem").agg(F.sum("n").alias("frequency"), F.count("*").alias("docs"))


@query()
def term_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, stem, hash) of the distinct terms of all order inputs, by the English stemmer."""
    words = table(spark, sf_dir, "test_cases").select(F.explode(word_break(_c("input"))).alias("term")).where("term <> ''")
    return dictionary(words, "term")


@query(
    """SELECT DISTINCT CAST(p_size AS BIGINT) + 4294967296 AS hash, true AS is_number, false AS is_token FROM part"""
)
def number_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, is_number, is_token): whole numbers as terms, hashed by the term model and by arithmetic alike."""
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    sizes = sizes.select(hash_of_stem(_c("p_size").cast("string")).alias("hash"), number_hash(_c("p_size")).alias("direct")).where("hash = direct")
    return sizes.select("hash", is_number_hash(_c("hash")).alias("is_number"), is_token_hash(_c("hash")).alias("is_token"))


# --- items, aliases, index -------------------------------------------------------------------------------------------


def _part_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as aliases (alias_id, pid, text, stems)."""
    parts = table(spark, sf_dir, "part").select(_c("p_partkey").alias("alias_id"), F.crc32("p_brand").alias("pid"), _c("p_name").alias("text"))
    return parts.withColumn("stems", F.transform(word_break(_c("text")), strip_plural))


_PART_TERMS = r"""(SELECT p_partkey AS alias_id, p_brand, p_name AS text, unnest(list_transform(string_split_regex(p_name, '\s+'),
    lambda t: regexp_replace(lower(t), 's$', ''))) AS stem FROM part)"""


@query(f"SELECT stem, list(alias_id ORDER BY alias_id) AS alias_ids, count(*) AS frequency FROM {_PART_TERMS} GROUP BY stem")
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, alias_ids, frequency) of part names; an alias stands in a list once per occurrence."""
    aliases = _part_aliases(spark, sf_dir).withColumn("hashes", _c("stems"))
    return L.postings(aliases).select("stem", "alias_ids", "frequency")


@query(
    f"SELECT stem AS term, count(DISTINCT p_brand) AS tokens, count(*) AS occurrences, list(DISTINCT text ORDER BY text) AS alias_texts FROM {_PART_TERMS} GROUP BY stem"
)
def posting_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, tokens, occurrences, alias_texts) of the index of part names."""
    return L.index_report(_part_aliases(spark, sf_dir))


@query(
    """SELECT p_type AS domain, CAST(min(p_partkey) AS INTEGER) AS ord, CAST(p_size AS BIGINT) AS pid, arg_max(p_name, p_partkey) AS name,
    [arg_max(p_brand, p_partkey)] AS aliases FROM part GROUP BY p_type, p_size"""
)
def item_dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with repeated pids: the last row's values at the first row's place."""
    items = table(spark, sf_dir, "part").select(
        _c("p_type").alias("domain"), _c("p_partkey").cast("int").alias("ord"), _c("p_size").cast("bigint").alias("pid"),
        _c("p_name").alias("name"), F.array("p_brand").alias("aliases"),
    )
    return last_wins(items)


@query(
    r"""WITH parts AS (SELECT p_partkey, lower(p_type) AS t, string_split(p_name, ' ') AS w FROM part),
    texts AS (SELECT p_partkey, unnest([t || ' ', '']) AS a, unnest([0, 1]) AS i, w FROM parts),
    halves AS (SELECT p_partkey, i * 2 AS k, trim(a || w[1] || ' x') AS text FROM texts UNION ALL SELECT p_partkey, i * 2 + 1, trim(a || w[2] || ' x') FROM texts)
    SELECT p_partkey, CAST(k AS INTEGER) AS expand_ord, text FROM halves"""
)
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, expand_ord, text): `[type] (word1,word2) x` of every part, expanded."""
    words = F.split("p_name", " ")
    pattern = F.concat(F.lit("["), F.lower("p_type"), F.lit("] ("), words[0], F.lit(","), words[1], F.lit(")  x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(expand_pattern(pattern)).alias("expand_ord", "text"))


@query(
    """SELECT pid, alias, CASE WHEN position(':' IN alias) = 0 THEN 'relaxed' ELSE trim(split_part(alias, ':', 1)) END AS matcher,
    CASE WHEN position(':' IN alias) = 0 THEN alias ELSE substr(alias, position(':' IN alias) + 1) END AS pattern
    FROM (SELECT pid, unnest(aliases) AS alias FROM catalog_items)"""
)
def matcher_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, alias, matcher, pattern) of every catalogue alias."""
    aliases = table(spark, sf_dir, "catalog_items").select("pid", F.explode("aliases").alias("alias"))
    return aliases.select("pid", "alias", alias_matcher(_c("alias")).alias("matcher"), alias_pattern(_c("alias")).alias("pattern"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) - 1 AS n FROM lineitem")
def dense_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers in a global order, without one task that sees all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return number_rows(lines, ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"], "n").drop("l_shipdate")


def _own_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, hash) where the hash is the stem itself."""
    sources = (("parts", "part", "p_name"), ("events", "events", "event_type"), ("nations", "nation", "n_name"), ("catalogue", "catalog_items", "name"))
    out = None
    for domain, name, column in sources:
        stems = table(spark, sf_dir, name).select(F.explode(word_break(_c(column))).alias("t")).select(strip_plural(_c("t")).alias("hash")).distinct()
        own = stems.select(F.lit(domain).alias("domain"), "hash")
        out = own if out is None else out.unionByName(own)
    return out


_OWN = r"""own AS (SELECT DISTINCT domain, regexp_replace(lower(t), 's$', '') AS hash FROM (
    SELECT 'parts' AS domain, unnest(string_split_regex(p_name, '\s+')) AS t FROM part
    UNION ALL SELECT 'events', unnest(string_split_regex(event_type, '\s+')) FROM events
    UNION ALL SELECT 'nations', unnest(string_split_regex(n_name, '\s+')) FROM nation
    UNION ALL SELECT 'catalogue', unnest(string_split_regex(name, '\s+')) FROM catalog_items))"""


@query(f"WITH {_OWN} SELECT domain, hash FROM own")
def own_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, hash): the stems of each of four domains."""
    return _own_terms(spark, sf_dir)


@query(
    f"""WITH {_OWN}, numbers AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS hash FROM part)
    SELECT DISTINCT a.domain, b.hash FROM (SELECT DISTINCT domain FROM own) a JOIN own b ON a.domain <> b.domain
    UNION SELECT a.domain, n.hash FROM (SELECT DISTINCT domain FROM own) a, numbers n"""
)
def downstream_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, hash): number terms and terms of other domains."""
    numbers = table(spark, sf_dir, "part").select(_c("p_size").cast("string").alias("hash")).distinct()
    return L.downstream_terms(_own_terms(spark, sf_dir), numbers)


@query(f"WITH {_OWN} SELECT DISTINCT hash AS term FROM own")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term): distinct stems of all domains."""
    return _own_terms(spark, sf_dir).select(_c("hash").alias("term")).distinct()


_STEMS = f"SELECT regexp_replace(lower(term), 's$', '') AS stem, list(DISTINCT term ORDER BY term) AS terms, count(DISTINCT term) AS n_terms FROM {_DOC_WORDS} WHERE term <> '' GROUP BY 1"


@query(_STEMS)
def stem_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, terms, n_terms): distinct words of all documents under each stem."""
    words = table(spark, sf_dir, "documents").select(F.explode(word_break(_c("text"))).alias("word")).where("word <> ''")
    return L.stem_groups(words, "word", strip_plural(_c("word")))


@query(f"SELECT n_terms > 1 AS collision, count(*) AS stems, CAST(sum(n_terms) AS BIGINT) AS words FROM ({_STEMS}) GROUP BY 1")
def stem_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collision, stems, words): how many stems stand for several words."""
    return stem_confusion(spark, sf_dir).groupBy((_c("n_terms") > 1).alias("collision")).agg(F.count("*").alias("stems"), F.sum("n_terms").alias("words"))


# --- joins of utterances with the index -------------------------------------------------------------------------------

_INPUT_WORDS = r"""(SELECT case_id, CAST(i - 1 AS INTEGER) AS start, w[i] AS hash FROM (SELECT case_id, w, unnest(generate_series(1, len(w))) AS i FROM
    (SELECT case_id, list_transform(string_split_regex(trim(input), '\s+'), lambda t: regexp_replace(lower(t), 's$', '')) AS w FROM test_cases WHERE trim(input) <> '')))"""
_NAME_POSTINGS = r"(SELECT pid, unnest(list_transform(string_split_regex(name, '\s+'), lambda t: regexp_replace(lower(t), 's$', ''))) AS hash FROM catalog_items)"


def _input_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "test_cases").where(F.trim("input") != "")
    return cases.select("case_id", F.posexplode(F.transform(word_break(F.trim("input")), strip_plural)).alias("start", "hash"))


def _name_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "catalog_items").select(_c("pid").alias("alias_id"), F.transform(word_break(_c("name")), strip_plural).alias("stems"))
    return aliases.select("alias_id", F.explode("stems").alias("hash"))


@query(f"SELECT pid, count(*) AS positions, count(DISTINCT case_id) AS cases FROM {_INPUT_WORDS} JOIN {_NAME_POSTINGS} USING (hash) GROUP BY pid")
def candidate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, positions, cases): positions of all inputs that share a term with each catalogue name."""
    found = E.candidates(_input_positions(spark, sf_dir), _name_postings(spark, sf_dir))
    per_case = found.groupBy(_c("alias_id").alias("pid"), "case_id").agg(F.count("*").alias("n"))
    return per_case.groupBy("pid").agg(F.sum("n").alias("positions"), F.count("*").alias("cases"))


@query(f"SELECT hash AS term, count(*) AS positions FROM {_INPUT_WORDS} w WHERE NOT EXISTS (SELECT 1 FROM {_NAME_POSTINGS} p WHERE p.hash = w.hash) GROUP BY 1")
def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, positions): terms of inputs that no catalogue name has. Positions are counted before the anti-join."""
    counts = _input_positions(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("positions"))
    return counts.join(_name_postings(spark, sf_dir), "hash", "left_anti").select(_c("hash").alias("term"), "positions")


@query(
    f"""WITH known AS (SELECT hash, min(pid) AS first_pid FROM {_NAME_POSTINGS} GROUP BY hash)
    SELECT DISTINCT hash AS term, CASE WHEN first_pid IS NULL THEN '###HASH' || hash || '###' ELSE hash END AS decoded FROM {_INPUT_WORDS} LEFT JOIN known USING (hash)"""
)
def decode_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, decoded): terms of inputs by the index's dictionary, marked where it has none."""
    terms = _input_positions(spark, sf_dir).select("hash").distinct()
    known = _name_postings(spark, sf_dir).select("hash", _c("hash").alias("stem")).distinct()
    joined = terms.join(known, "hash", "left")
    return joined.select(_c("hash").alias("term"), decode(_c("hash"), _c("stem")).alias("decoded"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query tails and prefixes of numbers, from neighbouring lines of the same order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (_c("l_suppkey") % 4).alias("t"))
    whole = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))).alias("x"))
    query_terms = F.transform("x", lambda e: e["t"])
    return whole.select("l_orderkey", query_terms.alias("query"), F.slice(F.reverse(query_terms), 1, 2).alias("prefix"))


_PAIRS = """pairs AS (SELECT l_orderkey, list(l_suppkey % 4 ORDER BY l_linenumber, l_suppkey % 4) AS query FROM lineitem GROUP BY l_orderkey),
cut AS (SELECT l_orderkey, query, list_reverse(query)[1:2] AS prefix FROM pairs),
runs AS (SELECT *, CASE WHEN query[1] <> prefix[1] THEN 0 WHEN len(prefix) = 1 THEN 1 WHEN query[2] = prefix[2] THEN 2 ELSE 1 END AS run FROM cut),
kept AS (SELECT *, CASE WHEN run = len(prefix) OR {partial} THEN run ELSE 0 END AS k FROM runs)
SELECT l_orderkey, CAST(len(prefix) - k AS DOUBLE) AS cost, CAST(k - 1 AS INTEGER) AS rightmost,
CASE WHEN k = 0 THEN NULL ELSE round(CASE WHEN k > len(prefix) - k THEN (k - (len(prefix) - k)) / CAST(k AS DOUBLE) ELSE CAST(1 AS DOUBLE) / len(prefix) END * k, 6) END AS score FROM kept"""


def _scored(spark: SparkSession, sf_dir: str, partial: bool) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("diff", exact_prefix_column(_c("query"), _c("prefix"), partial))
    rows = rows.withColumn("s", score_column(_c("diff"), _c("prefix")))
    return rows.select("l_orderkey", "diff.cost", "diff.rightmost", F.round("s.score", 6).alias("score"))


@query("WITH " + _PAIRS.format(partial="false"))
def exact_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, cost, rightmost, score) of the exact matcher, in Spark expressions."""
    return _scored(spark, sf_dir, False)


@query("WITH " + _PAIRS.format(partial="true"))
def prefix_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, cost, rightmost, score) of the prefix matcher, in Spark expressions."""
    return _scored(spark, sf_dir, True)


# --- formats ----------------------------------------------------------------------------------------


@query(
    r"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '[ENTITY:' || upper(regexp_replace(p_name, '\s', '_', 'g')) || ',' || p_partkey || ']'
    WHEN p_size % 5 = 1 THEN '[' || p_name || ']' WHEN p_size % 5 = 2 THEN '[QUANTIFIER:' || p_size || ']' WHEN p_size % 5 = 3 THEN '[WORD:' || p_brand || ']'
    ELSE '[UNKNOWN]' END AS token FROM part"""
)
def token_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, token): tokens of five types as text."""
    kinds = F.array(*map(F.lit, ("ENTITY", "INTENT", "QUANTIFIER", "WORD", "UNKNOWN")))
    kind = F.get(kinds, _c("p_size") % 5)
    text = token_text(kind, _c("p_partkey"), _c("p_name"), _c("p_size").cast("double"), _c("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("token"))


# --- graphs: lines of an order as edges --------------------------------------------------------------------------------


def _order_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges (query_id, start, ord, score, length, token_id) of every order, unknown ones included, and (query_id, n). Scores
    are quarters, so sums are exact."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity")
    sizes = lines.groupBy(_c("l_orderkey").alias("query_id")).agg(F.max("l_linenumber").alias("n"))
    found = lines.select(
        _c("l_orderkey").alias("query_id"), (_c("l_linenumber") - 1).alias("start"), _c("l_partkey").alias("ord"),
        (F.round(_c("l_discount") * 100) / 4).alias("score"), (_c("l_partkey") % 3 + 1).cast("int").alias("length"), (_c("l_suppkey") % 5).alias("token_id"),
    )
    places = sizes.select("query_id", F.explode(F.sequence(F.lit(0), _c("n") - 1)).alias("start"))
    return E.union_edges(E.unknown_edges(places), found), sizes


_EDGES = """sizes AS (SELECT l_orderkey AS query_id, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
found AS (SELECT l_orderkey AS query_id, CAST(l_linenumber - 1 AS INTEGER) AS start, l_partkey AS ord, round(l_discount * 100) / 4 AS score,
  CAST(l_partkey % 3 + 1 AS INTEGER) AS length, l_suppkey % 5 AS token_id FROM lineitem),
edges AS (SELECT query_id, CAST(unnest(generate_series(0, n - 1)) AS INTEGER) AS start, CAST(0 AS BIGINT) AS ord, CAST(0 AS DOUBLE) AS score, 1 AS length, CAST(-1 AS BIGINT) AS token_id
  FROM sizes UNION ALL SELECT * FROM found)"""


@query(f"WITH {_EDGES} SELECT query_id, start, ord, score, length, token_id FROM edges")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of all orders."""
    return _order_edges(spark, sf_dir)[0]


@query(f"WITH {_EDGES} SELECT query_id, start, ord, score, length, token_id FROM edges WHERE score >= 1 OR token_id = -1")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a score of 1 or more, and unknown ones."""
    return E.filter_edges(_order_edges(spark, sf_dir)[0], 1.0)


@query(
    f"""WITH {_EDGES} SELECT query_id, start, ord, score, length, token_id FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id, start, token_id, length ORDER BY score DESC, ord) AS rn FROM edges) WHERE rn = 1"""
)
def edge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best edge of each place, token and length."""
    return E.coalesce_edges(_order_edges(spark, sf_dir)[0])


_WALK = f"""WITH RECURSIVE {_EDGES},
best AS (SELECT query_id, start, length, token_id, arg_max(score, -ord) AS score FROM (SELECT *, rank() OVER (PARTITION BY query_id, start, length, token_id ORDER BY score, -ord) AS k,
  count(*) OVER (PARTITION BY query_id, start, length, token_id) AS c FROM edges) WHERE {{which}} GROUP BY ALL),
walk(query_id, place, tokens, total) AS (
  SELECT query_id, 0, '', CAST(0 AS DOUBLE) FROM sizes
  UNION ALL SELECT w.query_id, w.place + b.length, w.tokens || ' ' || b.token_id || '/' || b.length, w.total + b.score FROM walk w JOIN best b ON b.query_id = w.query_id AND b.start = w.place),
paths AS (SELECT w.query_id, w.tokens, w.total FROM walk w JOIN sizes s ON s.query_id = w.query_id AND s.n = w.place)
"""
# of edges with the same ends and token the last in the list, which is ordered best first, is the one that counts
_LAST = _WALK.replace("{which}", "k = 1")
_BEST = _WALK.replace("{which}", "k = c")


def _path_text(path):
    return F.array_join(F.transform(path, lambda e: F.concat(F.lit(" "), e["token_id"].cast("string"), F.lit("/"), e["length"].cast("string"))), "")


def _paths(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    edges, sizes = _order_edges(spark, sf_dir)
    return P.path_rows(E.edge_lists(edges, sizes), column)


@query(_LAST + "SELECT query_id, tokens, total FROM paths")
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, tokens, total): every path of every order's graph."""
    rows = _paths(spark, sf_dir, P.all_paths_column("edge_lists"))
    return rows.select("query_id", _path_text(_c("path")).alias("tokens"), _c("score").alias("total"))


@query(_BEST + "SELECT query_id, tokens, total FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY total DESC) AS r FROM paths) WHERE r = 1")
def maximal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, tokens, total): all paths of the greatest score, without listing the others."""
    rows = _paths(spark, sf_dir, P.maximal_paths_column("edge_lists"))
    return rows.select("query_id", _path_text(_c("path")).alias("tokens"), _c("score").alias("total"))


@query(_BEST + "SELECT query_id, max(total) AS total FROM paths GROUP BY 1")
def first_maximal_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, total): the first path of the greatest score."""
    return _paths(spark, sf_dir, P.maximal_paths_column("edge_lists", 1)).select("query_id", _c("score").alias("total"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (_c("l_partkey") % 50).alias("from"), (_c("l_partkey") % 50 + 1 + _c("l_suppkey") % 7).alias("to"), (_c("l_suppkey") % 11).alias("token"), _c("l_quantity").alias("score")
    )


_GRAPH = 'SELECT l_partkey % 50 AS "from", l_partkey % 50 + 1 + l_suppkey % 7 AS "to", l_suppkey % 11 AS token, l_quantity AS score FROM lineitem'


@query(f'SELECT "from", "to", token, max(score) AS score FROM ({_GRAPH}) GROUP BY ALL')
def graph_add_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph by their boundaries, the best score of each."""
    return P.add_edges(_graph(spark, sf_dir))


@query(f'SELECT "to", count(*) AS in_degree FROM (SELECT DISTINCT "from", "to", token FROM ({_GRAPH})) GROUP BY 1')
def graph_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(to, in_degree): distinct edges into each boundary."""
    return P.in_degrees(_graph(spark, sf_dir))


@query(f'SELECT "to", token, max(score) AS score FROM ({_GRAPH}) WHERE "from" = 7 GROUP BY ALL')
def graph_edges_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(to, token, score): edges out of one boundary."""
    return P.add_edges(_graph(spark, sf_dir)).where(_c("from") == 7).select("to", "token", "score")


# --- relevance -------------------------------------------------------------------------------------------------------

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY received_at DESC NULLS LAST, passed DESC NULLS LAST, elapsed_ms DESC NULLS LAST) AS rn
  FROM results) WHERE rn = 1 AND passed IS NOT NULL)"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_results(table(spark, sf_dir, "results"))


@query(
    _VALUES
    + f""", suites AS (SELECT DISTINCT case_id, item_value AS suite FROM values_found WHERE field = 'suites'), {_LATEST}
    SELECT suite, CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS n_passed, count(*) AS n_run FROM latest JOIN suites USING (case_id) GROUP BY 1"""
)
def relevance_by_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suite, n_passed, n_run): the last received results by the suites of their cases."""
    suites = split_packed(table(spark, sf_dir, "test_cases"), "case_id", {"suites": SEPARATED})
    return R.by_suite(_latest(spark, sf_dir), suites.select("case_id", _c("item_value").alias("suite")), "case_id")


@query(
    f"WITH {_LATEST} SELECT priority, CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS n_passed, count(*) AS n_run FROM latest JOIN test_cases USING (case_id) GROUP BY 1"
)
def relevance_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(priority, n_passed, n_run). Results are counted by case before they meet their cases."""
    counts = R.tally(_latest(spark, sf_dir), "case_id").join(table(spark, sf_dir, "test_cases").select("case_id", "priority"), "case_id")
    return counts.groupBy("priority").agg(F.sum("n_passed").alias("n_passed"), F.sum("n_run").alias("n_run"))


@query(f"WITH {_LATEST} SELECT CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS n_passed, count(*) AS n_run FROM latest")
def relevance_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_passed, n_run) of all results."""
    return R.tally(_latest(spark, sf_dir))


@query(f"WITH {_LATEST} SELECT case_id, count(*) AS failures FROM latest WHERE NOT passed GROUP BY 1")
def relevance_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, failures): cases with failing results."""
    return R.failing(_latest(spark, sf_dir).where("passed IS NOT NULL")).groupBy("case_id").agg(F.count("*").alias("failures"))


@query(
    _VALUES
    + f""", suites AS (SELECT DISTINCT case_id, item_value AS suite FROM values_found WHERE field = 'suites'), {_LATEST},
    judged AS (SELECT l.case_id, priority, input, expected, passed FROM latest l JOIN test_cases USING (case_id)),
    tallies AS (SELECT '2 suites' AS section, suite AS name, passed FROM latest JOIN suites USING (case_id) UNION ALL SELECT '3 priorities', coalesce(CAST(priority AS VARCHAR), ''), passed FROM judged
      UNION ALL SELECT '4 overall', 'overall', passed FROM latest)
    SELECT section, name, name || ': ' || sum(CAST(passed AS INTEGER)) || '/' || count(*) AS line FROM tallies GROUP BY section, name
    UNION ALL SELECT DISTINCT '1 cases', CAST(case_id AS VARCHAR), case_id || ' FAILED' || chr(10) || '   input: ' || coalesce(input, '') || chr(10) || 'expected: ' || coalesce(expected, '') || chr(10) || 'observed: ' FROM judged WHERE NOT passed"""
)
def relevance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, name, line): the report of the last received results, failing cases first, then suites, priorities and all."""
    suites = split_packed(table(spark, sf_dir, "test_cases"), "case_id", {"suites": SEPARATED}).select("case_id", _c("item_value").alias("suite"))
    latest = _latest(spark, sf_dir)
    failing = relevance_failing(spark, sf_dir).join(table(spark, sf_dir, "test_cases").select("case_id", "input", "expected"), "case_id")
    failing = failing.select(_c("case_id").alias("name"), "input", "expected", F.lit(None).cast("string").alias("observed"))
    return R.report(failing, R.by_suite(latest, suites, "case_id"), relevance_by_priority(spark, sf_dir), R.tally(latest))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(input, observed): tokens of every distinct order input, which is solved once."""
    cases = table(spark, sf_dir, "test_cases").where("kind = 'order' AND trim(input) <> ''")
    inputs = cases.select("input").distinct()
    lexicon = shop.shop_lexicon(spark, sf_dir, TermModel())
    said = inputs.withColumn("said", speech_text(_c("input"))).repartition(shuffle_partitions(spark))
    tiled = pipeline.tile(said, "input", "said", lexicon)
    return pipeline.token_strings(tiled, "input", pipeline.token_table(lexicon, shop.KINDS))


@query()
def utterance_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, observed): the tokens of every order input."""
    cases = table(spark, sf_dir, "test_cases").where("kind = 'order' AND trim(input) <> ''").select("case_id", "input")
    return cases.join(_observed(spark, sf_dir), "input").select("case_id", "observed")


def _expected(cases: DataFrame) -> DataFrame:
    """(case_id, wanted): token texts of the expected cells, read by the packed-field grammar."""
    tokens = split_packed(cases, "case_id", {"expected": BRACKETED})
    bracketed = F.concat(F.lit("["), label_form(_c("item_value")), F.lit("]"))
    wanted = tokens.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", bracketed.alias("t")))).alias("x"))
    return wanted.select("case_id", F.transform("x", lambda e: e["t"]).alias("wanted"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order cases with their observed tokens. One without an expectation stays, with none, and fails."""
    cases = table(spark, sf_dir, "test_cases").where("kind = 'order' AND trim(input) <> ''")
    wanted = _expected(cases).select("case_id", F.array_join("wanted", " ").alias("wanted"))
    joined = cases.join(wanted, "case_id", "left").drop("expected").withColumnRenamed("wanted", "expected")
    return R.evaluate(joined, _observed(spark, sf_dir), "input")


@query()
def utterance_relevance_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(priority, n_passed, n_run): order cases of which some path reads as expected. Cases without an expectation fail."""
    cases = table(spark, sf_dir, "test_cases").where("kind = 'order' AND trim(input) <> ''")
    tests = cases.join(_expected(cases), "case_id", "left").withColumn("said", speech_text(_c("input")))
    tests = tests.repartition(shuffle_partitions(spark))
    judged = pipeline.accepts(tests, "case_id", "said", "wanted", shop.shop_lexicon(spark, sf_dir), shop.KINDS)
    return R.tally(judged.join(cases.select("case_id", "priority"), "case_id"), "priority")


@query(
    "WITH "
    + _PAIRS.format(partial="true").split("SELECT l_orderkey, CAST(len(prefix) - k AS DOUBLE)")[0]
    + """SELECT l_orderkey, round(CASE WHEN k > len(prefix) - k THEN (k - (len(prefix) - k)) / CAST(k AS DOUBLE) ELSE CAST(1 AS DOUBLE) / len(prefix) END, 6) AS match_factor, k AS length_factor
    FROM kept WHERE k > 0"""
)
def score_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, match_factor, length_factor): factors of the prefix matcher's scores."""
    rows = _pairs(spark, sf_dir).withColumn("f", score_factors(exact_prefix_column(_c("query"), _c("prefix"), True)))
    return rows.where("f.length_factor > 0").select("l_orderkey", F.round("f.match_factor", 6).alias("match_factor"), "f.length_factor")


@query()
def utterance_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(priority, n_passed, n_run): order cases whose observed tokens are the expected ones. Cases without an expectation fail."""
    return R.tally(_evaluated(spark, sf_dir), "priority")


@query()
def relevance_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(priority, suites, input, expected): every order case that has an input, with what is observed as the new
    expectation, whether it had one or not."""
    return R.rebase(_evaluated(spark, sf_dir))
