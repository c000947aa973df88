"""Queries of graphs by their boundaries, tokenizations, edit distance and alias numbers, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilery.functions.matchers import levenshtein_column, score_column
from tilery.functions.speech import speech_text
from tilery.operators import edges as E
from tilery.operators import lexicon as L
from tilery.operators import paths as P
from tilery.operators.numbering import number_rows
from tilery.functions.terms import TermModel, strip_plural
from tilery.plans import pipeline, shop
from tilery.plans.engine_queries import _BEST, _LAST, _PAIRS, _order_edges, _pairs, _path_text
from tilery.plans.session import table
from tilery.plans.text_queries import _MURMUR

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# one table of costs and moves for each distinct pair, cell by cell; then back from its last cell
_LEVENSHTEIN = (
    "WITH RECURSIVE "
    + _PAIRS.format(partial="true").split("runs AS")[0]
    + """pairs_of AS (SELECT DISTINCT query AS q, prefix AS p, len(query) + 1 AS w, len(prefix) AS h FROM cut),
cells(q, p, w, h, k, d, m) AS (
  SELECT q, p, w, h, w, list_transform(range(w), lambda x: CAST(x AS DOUBLE)), list_transform(range(w), lambda x: 0) FROM pairs_of
  UNION ALL SELECT q, p, w, h, k + 1, list_append(d, v), list_append(m, CASE WHEN k % w = 0 THEN 0 WHEN skip <= up AND skip <= diag THEN 1 WHEN up <= diag THEN 2 ELSE 3 END) FROM (
    SELECT *, CASE WHEN k % w = 0 THEN k // w ELSE least(skip, up, diag) END AS v FROM (
      SELECT *, d[k] + 1 AS skip, d[k - w + 1] + 1 AS up, d[k - w] + CASE WHEN q[k % w] = p[k // w] THEN 0 ELSE 1 END AS diag FROM cells WHERE k < (h + 1) * w))),
back(q, p, w, d, m, b, a, cost, free, lft, rgt, found, common) AS (
  SELECT q, p, w, d, m, h, w - 1, d[(h + 1) * w], true, -1, -1, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM cells WHERE k = (h + 1) * w
  UNION ALL SELECT q, p, w, d, m, CASE WHEN how = 1 THEN b ELSE b - 1 END, CASE WHEN how = 2 THEN a ELSE a - 1 END, CASE WHEN how = 1 AND free THEN d[b * w + a] ELSE cost END, free AND how <> 3,
    CASE WHEN how = 2 THEN lft ELSE a - 1 END, CASE WHEN how = 3 AND rgt < 0 THEN a - 1 ELSE rgt END, CASE WHEN how = 3 THEN list_append(found, q[a]) ELSE found END,
    CASE WHEN how = 3 AND q[a] = p[b] THEN list_append(common, q[a]) ELSE common END
  FROM (SELECT *, m[b * w + a + 1] AS how FROM back) WHERE how <> 0),
ends AS (SELECT *, rgt + 1 AS size, len(found) AS n FROM back WHERE m[b * w + a + 1] = 0),
scored AS (SELECT q, p, cost, lft, rgt, CASE WHEN n > 0 THEN CASE WHEN size > cost THEN (size - cost) / size ELSE 1 / (size + cost) END
  * (len(list_distinct(common)) / CAST(len(list_distinct(found)) AS DOUBLE)) * greatest(n - lft, 0) END AS raw FROM ends)
SELECT l_orderkey, cost, CAST(lft AS INTEGER) AS leftmost, CAST(rgt AS INTEGER) AS rightmost, round(CASE WHEN raw <= 0.01 THEN -1 ELSE raw END, 6) AS score
FROM cut JOIN scored ON q = query AND p = prefix"""
)


@query(_LEVENSHTEIN)
def levenshtein_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, cost, leftmost, rightmost, score) of the relaxed matcher. Distinct pairs are matched once."""
    rows = _pairs(spark, sf_dir)
    distinct = rows.select("query", "prefix").distinct()
    matched = distinct.withColumn("diff", levenshtein_column("query", "prefix"))
    matched = matched.withColumn("s", score_column(F.col("diff"), F.col("prefix")))
    return rows.join(matched, ["query", "prefix"]).select("l_orderkey", "diff.cost", "diff.leftmost", "diff.rightmost", F.round("s.score", 6).alias("score"))


@query(
    r"""WITH RECURSIVE listed AS (SELECT domain, ord, pid, i AS alias_ord, aliases[i] AS e FROM (SELECT domain, ord, pid, aliases, unnest(range(1, len(aliases) + 1)) AS i FROM catalog_items)),
    patterns AS (SELECT domain, ord, pid, alias_ord, CASE WHEN contains(e, ':') THEN trim(split_part(e, ':', 1)) ELSE 'relaxed' END AS matcher,
      regexp_replace(CASE WHEN contains(e, ':') THEN substr(e, position(':' IN e) + 1) ELSE e END, '\s+', ' ', 'g') AS t FROM listed WHERE e IS NOT NULL),
    grown(domain, ord, pid, alias_ord, matcher, done, t, steps) AS (
      SELECT domain, ord, pid, alias_ord, matcher, '', t, CAST([] AS BIGINT[]) FROM patterns
      UNION ALL SELECT domain, ord, pid, alias_ord, matcher, trim(done || ' ' || trim(options[k])), substr(t, len(piece) + 1), list_append(steps, k) FROM (
        SELECT *, unnest(range(1, len(options) + 1)) AS k FROM (
          SELECT *, CASE WHEN starts_with(piece, '[') THEN list_append(string_split(piece[2:-2], ','), '') WHEN starts_with(piece, '(') THEN string_split(piece[2:-2], ',') ELSE [piece] END AS options
          FROM (SELECT *, regexp_extract(t, '^(\[[^\]]*\]|\([^)]*\)|[^\[(]+)', 1) AS piece FROM grown WHERE t <> '')))),
    whole AS (SELECT *, CASE domain WHEN 'bikes' THEN 1 WHEN 'parts' THEN 2 WHEN 'services' THEN 3 END AS place FROM grown WHERE t = '')
    SELECT row_number() OVER (ORDER BY place, ord, pid, alias_ord, steps) - 1 AS alias_id, domain, pid, matcher, done AS text FROM whole"""
)
def catalog_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alias_id, domain, pid, matcher, text): every expanded alias of the catalogue with its dense id."""
    rows = L.alias_rows(table(spark, sf_dir, "catalog_items"), ["bikes", "parts", "services"])
    numbered = number_rows(rows, ["domain_ord", "ord", "pid", "alias_ord", "expand_ord"], "alias_id")
    return numbered.select("alias_id", "domain", "pid", "matcher", "text")


# the steps of a path, taken apart again: tokens of `walk` are ' token/length' pieces
_SPANS = """, numbered AS (SELECT query_id, tokens, string_split(trim(tokens), ' ') AS steps FROM chosen),
steps AS (SELECT query_id, tokens, i, CAST(split_part(steps[i], '/', 1) AS BIGINT) AS token_id, CAST(split_part(steps[i], '/', 2) AS INTEGER) AS length
  FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM numbered))
SELECT query_id, tokens AS path, token_id, CAST(coalesce(sum(length) OVER (PARTITION BY query_id, tokens ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, length FROM steps"""


def _tokenizations(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    edges, sizes = _order_edges(spark, sf_dir)
    rows = P.path_rows(E.edge_lists(edges, sizes), column).withColumn("text", _path_text(F.col("path")))
    return rows.select("query_id", F.col("text").alias("path"), F.explode(P.spans(F.col("path"))).alias("s")).select("query_id", "path", "s.token_id", "s.start", "s.length")


@query(_LAST.replace("paths AS (", "chosen AS (") + _SPANS)
def all_tokenizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, path, token_id, start, length): every path of every order's graph as token spans."""
    return _tokenizations(spark, sf_dir, P.all_paths_column("edge_lists"))


@query(_BEST + ", chosen AS (SELECT query_id, tokens FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY total DESC) AS r FROM paths) WHERE r = 1)" + _SPANS)
def maximal_tokenizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, path, token_id, start, length): the paths of the greatest score as token spans."""
    return _tokenizations(spark, sf_dir, P.maximal_paths_column("edge_lists"))


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (key, from, to, token, score) of one graph for each order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), (F.col("l_linenumber") - 1).cast("int").alias("from"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("to"),
        (F.col("l_suppkey") % 5).alias("token"), (F.round(F.col("l_discount") * 100) / 4).alias("score"),
    )


_GRAPHS = """drawn AS (SELECT l_orderkey AS key, l_linenumber - 1 AS f, l_linenumber + l_partkey % 3 AS t, l_suppkey % 5 AS token, max(round(l_discount * 100) / 4) AS score FROM lineitem GROUP BY ALL),
ends AS (SELECT key, max(t) AS n FROM drawn GROUP BY 1),
walk(key, place, tokens, total) AS (SELECT key, CAST(0 AS BIGINT), '', CAST(0 AS DOUBLE) FROM ends
  UNION ALL SELECT w.key, d.t, w.tokens || ' ' || d.token || '/' || (d.t - d.f), w.total + d.score FROM walk w JOIN drawn d ON d.key = w.key AND d.f = w.place),
paths AS (SELECT w.key, w.tokens, w.total FROM walk w JOIN ends e ON e.key = w.key AND e.n = w.place)"""


@query(f"WITH RECURSIVE {_GRAPHS} SELECT key, tokens, total FROM paths")
def graph_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, tokens, total): every path from 0 to the last boundary of graphs given by their boundaries."""
    rows = P.path_rows(P.boundary_lists(_graphs(spark, sf_dir), "key"), P.all_paths_column("edge_lists"))
    return rows.select(F.col("query_id").alias("key"), _path_text(F.col("path")).alias("tokens"), F.col("score").alias("total"))


@query(f"WITH RECURSIVE {_GRAPHS} SELECT key, tokens, total FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY total DESC) AS r FROM paths) WHERE r = 1")
def graph_maximal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, tokens, total): the paths of the greatest score of graphs given by their boundaries."""
    rows = P.path_rows(P.boundary_lists(_graphs(spark, sf_dir), "key"), P.maximal_paths_column("edge_lists"))
    return rows.select(F.col("query_id").alias("key"), _path_text(F.col("path")).alias("tokens"), F.col("score").alias("total"))


@query('SELECT key, count(*) AS vertices FROM (SELECT l_orderkey AS key, l_linenumber - 1 AS v FROM lineitem UNION SELECT l_orderkey, l_linenumber + l_partkey % 3 FROM lineitem) GROUP BY 1')
def graph_vertex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, vertices): boundaries that edges of a graph touch."""
    return P.vertex_counts(_graphs(spark, sf_dir), "key")


@query(
    """WITH RECURSIVE links AS (SELECT DISTINCT l_orderkey AS token, l_partkey % 5 AS f, l_suppkey % 6 AS t FROM lineitem),
    reach(token, f, t) AS (SELECT token, f, t FROM links UNION SELECT r.token, r.f, l.t FROM reach r JOIN links l ON l.token = r.token AND l.f = r.t)
    SELECT token, NOT bool_or(f = t) AS dag FROM reach GROUP BY 1"""
)
def graph_is_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, dag): whether the graph of each order can be put in a topological order; edges lead in any direction."""
    lines = table(spark, sf_dir, "lineitem")
    return P.is_dag(lines.select(F.col("l_orderkey").alias("token"), (F.col("l_partkey") % 5).alias("from"), (F.col("l_suppkey") % 6).alias("to")), "token")


@query()
def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, end, score): the best match of the prefix 1 2 along the paths of every order's graph from its beginning, by the
    boundary that it reaches."""
    edges, sizes = _order_edges(spark, sf_dir)
    found = P.lattice_matches_column("edge_lists", F.lit(0), F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))
    return E.edge_lists(edges, sizes).select("query_id", F.explode(found).alias("m")).select("query_id", "m.end", "m.score")


# --- the relational form ------------------------------------------------------------------------------------------------


def _name_lexicon(spark: SparkSession, sf_dir: str) -> L.Lexicon:
    """Catalogue names as exact aliases, stemmed by expressions."""
    items = table(spark, sf_dir, "catalog_items").withColumn("aliases", F.array(F.concat(F.lit("exact:"), "name")))
    return L.build_lexicon(items, ["bikes", "parts", "services"], TermModel(column_stemmer=strip_plural))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test_cases").where("trim(input) <> ''").select("input").distinct()


_STEM_LIST = lambda x: rf"list_transform(string_split_regex(trim({x}), '\s+'), lambda t: CASE WHEN starts_with(t, '@') THEN t ELSE regexp_replace(lower(t), 's$', '') END)"
_NAMED = rf"""said AS (SELECT DISTINCT input, {_STEM_LIST('input')} AS w FROM test_cases WHERE trim(input) <> ''),
names AS (SELECT row_number() OVER (ORDER BY CASE domain WHEN 'bikes' THEN 1 WHEN 'parts' THEN 2 ELSE 3 END, ord, pid) - 1 AS alias_id, {_STEM_LIST('name')} AS p FROM catalog_items),
places AS (SELECT input, w, unnest(range(0, len(w))) AS i FROM said),
met AS (SELECT DISTINCT input, w, i, alias_id, p FROM places JOIN names ON w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p)"""


@query(
    f"""WITH RECURSIVE {_NAMED}, ends AS (SELECT input, list(struct_pack(e := i + len(p), n := len(p))) AS m FROM met GROUP BY 1),
    best(input, n, i, b, m) AS (SELECT input, len(w), 0, [CAST(0 AS DOUBLE)], coalesce(m, []) FROM said LEFT JOIN ends USING (input)
      UNION ALL SELECT input, n, i + 1, list_append(b, greatest(b[i + 1], coalesce(list_max(list_transform(list_filter(m, lambda x: x.e = i + 1), lambda x: b[i + 2 - x.n] + x.n)), 0))), m FROM best WHERE i < n)
    SELECT input, CAST(n AS INTEGER) AS terms, b[n + 1] AS covered FROM best WHERE i = n"""
)
def name_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(input, terms, covered): how many terms of each input the best tiling by catalogue names covers, in the relational form."""
    lexicon = _name_lexicon(spark, sf_dir)
    words, graphs = pipeline.graphs_relational(_said(spark, sf_dir), "input", "input", lexicon, numbers=lambda hashes: [])
    first = P.path_rows(graphs, P.maximal_paths_column("edge_lists", 1))
    return words.join(first, "query_id").select(F.col("query_id").alias("input"), F.size("terms").alias("terms"), F.col("score").alias("covered"))


@query(
    f"""WITH RECURSIVE {_NAMED}, held AS (SELECT DISTINCT unnest(p) AS term FROM names), x AS (SELECT DISTINCT unnest(w) AS term FROM said), {_MURMUR},
    coded AS (SELECT term, CASE WHEN held.term IS NOT NULL THEN term ELSE '###HASH' || CASE WHEN starts_with(term, '@') THEN murmur + 8589934592
      WHEN regexp_full_match(term, '[0-9]+') THEN TRY_CAST(term AS BIGINT) + 4294967296 ELSE murmur END || '###' END AS text FROM hashes LEFT JOIN held USING (term)),
    found AS (SELECT DISTINCT input, i AS start, alias_id, w, p, len(list_filter(range(1, len(p) + 1), lambda k: w[i + 1:i + k] = p[1:k])) AS run FROM places JOIN names ON list_contains(p, w[i + 1])),
    kept AS (SELECT *, CASE WHEN run = len(p) THEN run ELSE 0 END AS k FROM found),
    rests AS (SELECT input, i AS start, (SELECT string_agg(text, ' ' ORDER BY k) FROM (SELECT unnest(w[i + 1:]) AS term, unnest(range(len(w) - i)) AS k) JOIN coded USING (term)) AS query FROM places)
    SELECT input, CAST(start AS INTEGER) AS start, alias_id, query, array_to_string(p, ' ') AS prefix, array_to_string(p[1:k], ' ') AS match, CASE WHEN k > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / len(p) END AS match_factor,
      CASE WHEN k > 0 THEN CAST(1 AS DOUBLE) END AS common_factor, CASE WHEN k > 0 THEN CAST(1 AS DOUBLE) END AS position_factor, CAST(k AS INTEGER) AS length_factor FROM kept JOIN rests USING (input, start)"""
)
def match_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(input, start, alias_id, query, prefix, match, and the four factors of the score) of every candidate of catalogue names."""
    lexicon = _name_lexicon(spark, sf_dir)
    source = _said(spark, sf_dir).withColumnRenamed("input", "query_id").withColumn("text", F.col("query_id"))
    found = E.candidates(E.tails(L.hashed(source, ["query_id"], "text", lexicon.model, lexicon.below())), E.known_postings(lexicon.posting_rows().distinct(), lexicon.aliases))
    texts = lexicon.postings().select("hash", F.col("stem").alias("text"))
    return E.trace_matches(found, texts).withColumnRenamed("query_id", "input")


@query()
def utterance_tokens_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, observed): the tokens of every order input by joins; the rows are those of utterance_tokens."""
    cases = table(spark, sf_dir, "test_cases").where("kind = 'order' AND trim(input) <> ''").select("case_id", "input")
    lexicon = shop.shop_lexicon(spark, sf_dir)
    said = cases.select("input").distinct().withColumn("said", speech_text(F.col("input")))
    observed = pipeline.token_strings(pipeline.tile_relational(said, "input", "said", lexicon), "input", pipeline.token_table(lexicon, shop.KINDS))
    return cases.join(observed, "input").select("case_id", "observed")
