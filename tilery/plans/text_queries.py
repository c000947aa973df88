"""Queries of term hashes, number words, speech text, string matchers and row checks, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilery.functions.matchers import match_string_column
from tilery.functions.numbers import TENS, UNITS, digits_to_words, number_matches
from tilery.functions.speech import speech_text
from tilery.functions.terms import hash_of_stem, strip_plural, word_break
from tilery.operators import edges as E
from tilery.plans.session import table
from tilery.sources.catalog import invalid_items, invalid_tests

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# Murmur3 of the bytes of x(term) in 32 bits, four bytes a step; products are taken in 128 bits
_TURN = lambda x, r: f"((CAST({x} AS HUGEINT) * {1 << r}) % 4294967296 + {x} // {1 << 32 - r})"
_TIMES = lambda x, c: f"(CAST({x} AS HUGEINT) * {c} % 4294967296)"
_MIXED = lambda k: _TIMES(_TURN(_TIMES(k, 0xCC9E2D51), 15), 0x1B873593)
_XOR = lambda x, y: f"xor(CAST({x} AS BIGINT), CAST({y} AS BIGINT))"
_BYTES = lambda at, n: " + ".join(f"CASE WHEN {at} + {i} < n THEN CAST('0x' || substr(h, 2 * CAST({at} AS INTEGER) + {2 * i + 1}, 2) AS BIGINT) * {256**i} ELSE 0 END" for i in range(n))
_MURMUR = f"""
bytes AS (SELECT term, hex(term) AS h, len(hex(term)) // 2 AS n FROM x),
steps(term, h, n, p, s) AS (
  SELECT term, h, n, 0, CAST(0 AS BIGINT) FROM bytes
  UNION ALL SELECT term, h, n, p + 4, CAST((CAST({_TURN(_XOR('s', _MIXED(_BYTES('p', 4))), 13)} AS HUGEINT) * 5 + {0xE6546B64}) % 4294967296 AS BIGINT) FROM steps WHERE p + 4 <= n),
tails AS (SELECT term, n, {_XOR(_XOR('s', 'CASE WHEN p < n THEN ' + _MIXED('(' + _BYTES('p', 3) + ')') + ' ELSE 0 END'), 'n')} AS s FROM steps WHERE p + 4 > n),
m1 AS (SELECT term, CAST({_TIMES(_XOR('s', 's // 65536'), 0x85EBCA6B)} AS BIGINT) AS s FROM tails),
m2 AS (SELECT term, CAST({_TIMES(_XOR('s', 's // 8192'), 0xC2B2AE35)} AS BIGINT) AS s FROM m1),
hashes AS (SELECT term, {_XOR('s', 's // 65536')} AS murmur FROM m2)"""


@query(
    rf"""WITH RECURSIVE x AS (SELECT DISTINCT regexp_replace(lower(t), 's$', '') AS term FROM (
      SELECT unnest(string_split_regex(p_name, '\s+')) AS t FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT '@' || p_brand FROM part
      UNION ALL SELECT unnest(string_split_regex(trim(input), '\s+')) FROM test_cases) WHERE t <> ''), {_MURMUR}
    SELECT term, CASE WHEN starts_with(term, '@') THEN murmur + 8589934592 WHEN regexp_full_match(term, '[0-9]+') THEN TRY_CAST(term AS BIGINT) + 4294967296 ELSE murmur END AS hash FROM hashes"""
)
def stem_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, hash): words of names and inputs, numbers and token references in their ranges."""
    parts, cases = table(spark, sf_dir, "part"), table(spark, sf_dir, "test_cases")
    terms = parts.select(F.explode(word_break(F.col("p_name"))).alias("t"))
    terms = terms.unionByName(parts.select(F.col("p_size").cast("string").alias("t"))).unionByName(parts.select(F.concat(F.lit("@"), "p_brand").alias("t")))
    terms = terms.unionByName(cases.select(F.explode(word_break(F.trim("input"))).alias("t"))).where("t <> ''")
    return terms.select(strip_plural(F.col("t")).alias("term")).distinct().withColumn("hash", hash_of_stem("term"))


_UNITS, _TENS = list(UNITS), list(TENS)
# vals(v) to spelt(v, words)
_SPELT = f"""
small AS (SELECT n, trim(concat_ws(' ', CASE WHEN n >= 100 THEN {_UNITS}[n // 100] || ' hundred' END,
    CASE WHEN n % 100 >= 20 THEN {_TENS}[(n % 100) // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || {_UNITS}[n % 10] ELSE '' END WHEN n % 100 > 0 THEN {_UNITS}[n % 100] END)) AS w
  FROM (SELECT unnest(range(1000)) AS n)),
periods AS (SELECT v, k, (v // CAST(pow(1000, k) AS BIGINT)) % 1000 AS n FROM (SELECT v, unnest(range(5)) AS k FROM vals)),
whole AS (SELECT v, string_agg(w || ['', ' thousand', ' million', ' billion', ' trillion'][k + 1], ', ' ORDER BY k DESC) AS words FROM periods JOIN small USING (n) WHERE n > 0 GROUP BY v
  UNION ALL SELECT 0, 'zero'),
spelt AS (SELECT v, regexp_replace(regexp_replace(words, '-', ' '), ',', '') AS words FROM whole)"""
_VALUE = "(l_orderkey * 2654435761 + l_suppkey * 40503 + l_linenumber) % CAST(pow(10, l_partkey % 12 + 1) AS BIGINT)"


@query(f"WITH vals AS (SELECT DISTINCT {_VALUE} AS v FROM lineitem), {_SPELT} SELECT v AS value, words, v AS parsed FROM vals JOIN spelt USING (v)")
def number_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, words, parsed): numbers of all magnitudes below 10^12 to words, and back by the number grammar."""
    lines = table(spark, sf_dir, "lineitem")
    value = (F.col("l_orderkey") * F.lit(2654435761) + F.col("l_suppkey") * 40503 + F.col("l_linenumber")) % F.pow(F.lit(10), F.col("l_partkey") % 12 + 1).cast("bigint")
    spelt = lines.select(value.alias("value")).distinct().withColumn("words", digits_to_words("value"))
    read = number_matches(F.split(F.regexp_replace(F.regexp_replace("words", "-", " "), ",", ""), " "))
    return spelt.withColumn("m", read).select("value", "words", F.element_at("m", -1)["value"].alias("parsed"))


@query(
    f"""WITH vals AS (SELECT unnest(range(1, 100)) AS v), {_SPELT},
    phrases AS (SELECT DISTINCT p_size % 9 + 1 AS a, p_partkey % 99 + 1 AS b FROM part)
    SELECT {_UNITS}[a] || ' hundred and ' || words AS phrase, CAST(a * 100 + b AS BIGINT) AS value, CAST(CASE WHEN b > 20 AND b % 10 <> 0 THEN 4 ELSE 3 END AS INTEGER) AS length FROM phrases JOIN spelt ON v = b"""
)
def number_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phrase, value, length): the longest reading of hundreds with `and`, which isn't counted."""
    pairs = table(spark, sf_dir, "part").select((F.col("p_size") % 9 + 1).alias("a"), (F.col("p_partkey") % 99 + 1).alias("b")).distinct()
    phrase = F.concat(digits_to_words("a"), F.lit(" hundred and "), F.regexp_replace(digits_to_words("b"), "-", " "))
    rows = pairs.select(phrase.alias("phrase")).withColumn("m", F.element_at(number_matches(F.split("phrase", " ")), -1))
    return rows.select("phrase", "m.value", "m.length")


@query(
    """WITH sizes AS (SELECT DISTINCT p_size AS v, p_size > 20 AND p_size % 10 <> 0 AS two FROM part)
    SELECT v AS size, 0 AS start, CAST(CASE WHEN two THEN v - v % 10 ELSE v END AS BIGINT) AS value, 1 AS length FROM sizes
    UNION ALL SELECT v, 0, CAST(v AS BIGINT), 2 FROM sizes WHERE two UNION ALL SELECT v, 1, CAST(v % 10 AS BIGINT), 1 FROM sizes WHERE two"""
)
def number_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(size, start, value, length): every number edge at every place of the spelt-out part sizes."""
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    words = sizes.select(F.col("p_size").alias("query_id"), F.split(F.regexp_replace(digits_to_words("p_size"), "-", " "), " ").alias("words"))
    edges = E.number_edges(words)
    return edges.select(F.col("query_id").alias("size"), "start", (F.lit(-2).cast("bigint") - F.col("token_id")).alias("value"), "length")


@query(
    rf"""WITH cleaned AS (SELECT case_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(input, '&', ' and '), '%', ' percent '), '[‘’]', '''', 'g'),
      '[,.?!"“”\-()]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS words FROM test_cases WHERE input IS NOT NULL),
    vals AS (SELECT DISTINCT CAST(w AS BIGINT) AS v FROM (SELECT unnest(words) AS w FROM cleaned) WHERE regexp_full_match(w, '[0-9]+')), {_SPELT},
    named AS (SELECT map(list(CAST(v AS VARCHAR)), list(words)) AS m FROM spelt)
    SELECT case_id, array_to_string(list_transform(words, lambda w: CASE WHEN lower(w) = 'okay' THEN 'ok' WHEN w = '1/2' THEN 'half' WHEN w = '1/4' THEN 'quarter'
      WHEN regexp_full_match(w, '[0-9]+') THEN m[CAST(CAST(w AS BIGINT) AS VARCHAR)] ELSE w END), ' ') AS said FROM cleaned, named"""
)
def speech_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, said): every input through the whole speech normaliser."""
    return table(spark, sf_dir, "test_cases").where("input IS NOT NULL").select("case_id", speech_text(F.col("input")).alias("said"))


_STRINGS = "strings AS (SELECT DISTINCT p_name AS q, string_split(p_name, ' ')[1] || substr(p_type, 1, p_size % 4) AS p, p_size % 2 = 0 AS partial FROM part)"


@query(
    f"""WITH {_STRINGS}, runs AS (SELECT *, list_max(list_filter(range(0, len(p) + 1), lambda k: q[1:k] = p[1:k])) AS run FROM strings),
    kept AS (SELECT *, CASE WHEN run = len(p) OR partial THEN run ELSE 0 END AS k FROM runs)
    SELECT q AS query, p AS prefix, partial, q[1:k] AS match, CAST(len(p) - k AS DOUBLE) AS cost, CAST(k - 1 AS INTEGER) AS rightmost, CAST(k AS INTEGER) AS alignments FROM kept"""
)
def string_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, prefix, partial, match, cost, rightmost, alignments): exact and prefix matchers over the characters of names."""
    word = F.split("p_name", " ")[0]
    parts = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("query"), F.concat(word, F.substring("p_type", F.lit(1), F.col("p_size") % 4)).alias("prefix"), (F.col("p_size") % 2 == 0).alias("partial")
    )
    matchers = F.when(F.col("partial"), match_string_column("query", "prefix", "prefix")).otherwise(match_string_column("query", "prefix", "exact"))
    return parts.distinct().withColumn("m", matchers).select("query", "prefix", "partial", "m.match", "m.cost", "m.rightmost", "m.alignments")


@query(
    """SELECT item_key, problem FROM (SELECT item_key, unnest([CASE WHEN name IS NULL THEN 'name must be a string' END,
    CASE WHEN aliases IS NULL OR len(list_filter(aliases, lambda a: a IS NULL)) > 0 THEN 'aliases must be a list of strings' END,
    CASE WHEN pid IS NULL THEN 'pid must be a number' END]) AS problem FROM shop_items) WHERE problem IS NOT NULL"""
)
def item_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_key, problem): rows of loaded items that break the item schema, and how."""
    return invalid_items(table(spark, sf_dir, "shop_items"), "item_key")


@query(
    """SELECT case_id, problem FROM (SELECT case_id, unnest([CASE WHEN priority IS NULL THEN 'priority must be an integer' END, CASE WHEN suites IS NULL THEN 'suites must be a string' END,
    CASE WHEN input IS NULL THEN 'input must be a string' END, CASE WHEN expected IS NULL THEN 'expected must be a string' END]) AS problem FROM test_cases) WHERE problem IS NOT NULL"""
)
def test_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, problem): test cases that break the test schema, and how."""
    return invalid_tests(table(spark, sf_dir, "test_cases"), "case_id")
