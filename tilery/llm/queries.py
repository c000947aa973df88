"""Queries of the llm operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilery.functions.text import alias_forms, item_terms
from tilery.llm import frequency, leaks, mapping, mixing, personal, setjoin, weights
from tilery.operators.items import live_items
from tilery.plans.session import table

#: Two sets of aliases agree if this share of their elements is common; smaller sets are not compared.
ALIAS_SHARE, ALIAS_LEAST = Fraction(3, 5), 3
#: An input means an item only if it has this share of the features of every distinctive word of its name.
AS_SUCH = 0.25


def _live(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return live_items(table(spark, sf_dir, "shop_items"), keep=keep)


def _weights(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    # terms are read before the rows are shuffled to their keys: a Python step behind the shuffle would make Spark
    # forget that a record's rows are in one place
    items = table(spark, sf_dir, "shop_items").withColumn("terms", item_terms("name", "aliases"))
    items = live_items(items, keep=("terms",))
    return weights.log_entropy(items, "item_key", "terms", within=("collection_id", "pid"), **limits)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookups = table(spark, sf_dir, "test_cases").where(F.col("kind") == "lookup").select("case_id", "input")
    catalog = table(spark, sf_dir, "catalog_items")
    return mapping.map_values(lookups, "case_id", "input", catalog, "pid", "name", cover=AS_SUCH)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, pid): the catalogue item each lookup means, or -1."""
    return _mapped(spark, sf_dir).select("case_id", "pid")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(input_form, cases): what was asked for and isn't in the catalogue, by its plain form."""
    lookups = table(spark, sf_dir, "test_cases").select("case_id", mapping.plain_form("input").alias("input_form"))
    missing = _mapped(spark, sf_dir).where(F.col("pid") == mapping.UNMATCHED)
    return missing.join(lookups, "case_id").groupBy("input_form").agg(F.count("*").alias("cases"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_key, term): terms that at least 2 and at most 6 live items hold."""
    return _weights(spark, sf_dir, min_records=2, max_records=6).select("item_key", "term")


def p2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_key, term, tf, records, weight): log-entropy weight of every term of every live item."""
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_key_a, item_key_b): live items whose aliases agree to 0.6."""
    items = _live(spark, sf_dir, "aliases").select("item_key", alias_forms("aliases").alias("forms"))
    return setjoin.similar_pairs(items, "item_key", "forms", ALIAS_SHARE, ALIAS_LEAST)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_key, class_id, links): class of equal alias sets of each live item, by the least item_key in it, and how many
    items are similar."""
    items = _live(spark, sf_dir, "aliases").select("item_key", alias_forms("aliases").alias("forms"))
    return setjoin.similar_counts(items, "item_key", "forms", ALIAS_SHARE, ALIAS_LEAST)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = _live(spark, sf_dir, "aliases").select(F.lit("aliases").alias("field"), F.col("aliases").alias("texts"))
    inputs = table(spark, sf_dir, "test_cases").where(F.col("input").isNotNull())
    inputs = inputs.select(F.lit("input").alias("field"), F.array("input").alias("texts"))
    texts = aliases.unionByName(inputs)
    totals = texts.groupBy("field").agg(F.count("*").alias("n_records"))
    return frequency.mark_terms(frequency.term_frequency(texts, {"aliases": True, "input": False}), totals)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, mark): terms of aliases and inputs that are rare or common."""
    return _marked(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term_id, term, occurrences, records, mark) of every term; identifiers are dense, in the order of the terms."""
    return _marked(spark, sf_dir)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    return leaks.search_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents with 13 consecutive words of an evaluation item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, documents, longest, answers): how many documents leak each item, the most runs of it in one, and how many of
    them have its answer too."""
    found = _leaks(spark, sf_dir).groupBy("item_id")
    return found.agg(F.count("*").alias("documents"), F.max("runs").alias("longest"), F.count_if("answer").alias("answers"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    documents, targets = table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "mix_targets")
    return mixing.mix_sources(documents, targets, "doc_id", "text", "source")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source): targets that stay below their share of a mix as large as all documents with a listed source, with every
    document repeated as often as allowed; documents of other sources are soft members by the classifier's posteriors."""
    return _mix(spark, sf_dir).report.where("short").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, weight, target, expected, reached, reached_share): the shares reached by the mix."""
    return mixing.reached_shares(_mix(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, found_text): distinct stretches of personal information of every document."""
    found = personal.find_personal(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "kind", "found_text").distinct()


def p8_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document with placeholders for personal information."""
    return personal.replace_personal(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_unmatched": p1_unmatched,
    "p2_found": p2_found,
    "p2_weights": p2_weights,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_replaced": p8_replaced,
}

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
# DuckDB has no NFKC; full-width forms and compositions are what the tables hold of it
_BASE = f"lower(nfc_normalize(translate(@, '{_WIDE}', '{_PLAIN}')))"


def name_sql(x: str) -> str:
    return r"trim(regexp_replace(" + _BASE.replace("@", x, 1) + r", '[^\p{L}\p{Nd}]+', ' ', 'g'))"


def alias_sql(x: str) -> str:
    cut = r"regexp_replace(" + _BASE.replace("@", x, 1) + r", '^[\s\p{Z}]*(exact|relaxed|prefix)[\s\p{Z}]*:', '')"
    return r"trim(regexp_replace(" + cut + r", '[^\p{L}\p{Nd}]+', ' ', 'g'))"


_LIVE = """
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, pid ORDER BY loaded_at DESC NULLS LAST, item_key DESC) AS rn
  FROM shop_items) WHERE rn = 1)"""
_ITEM_TERMS = f"""
WITH {_LIVE}, forms AS (
  SELECT item_key, {name_sql('name')} AS f FROM live
  UNION ALL SELECT item_key, {alias_sql('a')} FROM (SELECT item_key, unnest(aliases) AS a FROM live)
), terms AS (SELECT item_key, term FROM (SELECT item_key, unnest(string_split(f, ' ')) AS term FROM forms) WHERE term <> ''),
tf AS (SELECT item_key, term, count(*) AS tf FROM terms GROUP BY ALL),
st AS (SELECT term, count(*) AS records, sum(tf) AS occ, sum(tf * ln(tf)) AS spread FROM tf GROUP BY term)
"""
_SETS = f"""
WITH {_LIVE}, forms AS (
  SELECT DISTINCT item_key, {alias_sql('a')} AS f FROM (SELECT item_key, unnest(aliases) AS a FROM live)
), filled AS (SELECT item_key, f FROM forms WHERE f <> ''),
sizes AS (SELECT item_key, count(*) AS n FROM filled GROUP BY 1 HAVING count(*) >= 3),
shared AS (SELECT a.item_key AS x, b.item_key AS y, count(*) AS c FROM filled a JOIN filled b ON a.f = b.f AND a.item_key < b.item_key GROUP BY 1, 2),
pairs AS (SELECT x, y FROM shared JOIN sizes s ON s.item_key = x JOIN sizes t ON t.item_key = y WHERE 5 * c >= 3 * (s.n + t.n - c))
"""
_COUNTED = f"""
WITH {_LIVE}, texts AS (
  SELECT 'aliases' AS field, item_key AS id, {alias_sql('a')} AS f FROM (SELECT item_key, unnest(aliases) AS a FROM live)
  UNION ALL SELECT 'input', case_id, {name_sql('input')} FROM test_cases WHERE input IS NOT NULL
), terms AS (SELECT * FROM (SELECT field, id, unnest(string_split(f, ' ')) AS term FROM texts) WHERE term <> ''),
totals AS (SELECT 'aliases' AS field, count(*) AS n FROM live UNION ALL SELECT 'input', count(*) FROM test_cases WHERE input IS NOT NULL),
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM terms GROUP BY ALL),
marked AS (SELECT field, term, occurrences, records,
  CASE WHEN records <= 2 THEN 'rare' WHEN records > n * CAST(0.1 AS DOUBLE) THEN 'common' END AS mark FROM counts JOIN totals USING (field))
"""

def _plain_sql(x: str) -> str:
    base = f"lower(strip_accents(translate({x}, '{_WIDE}', '{_PLAIN}')))"
    return r"trim(regexp_replace(" + base + r", '[^\p{L}\p{N}]+', ' ', 'g'))"


def _grams_sql(x: str) -> str:
    """The distinct features of a plain text."""
    cut = lambda w, n: f"[g for g in list_transform(range(1, len({w}) - {n - 2}), lambda i: {w}[i:i + {n - 1}]) if NOT contains(g, ' ')]"
    marked = f"('^' || replace({x}, ' ', '$ ^') || '$')"
    bare = f"array_to_string(list_transform(string_split({x}, ' '), lambda w: w[1] || regexp_replace(w[2:], '[aeiou]', '', 'g')), ' ')"
    tilde = lambda n: f"list_transform({cut(bare, n)}, lambda g: '~' || g)"
    return f"list_distinct(list_concat(list_concat({cut(marked, 2)}, {cut(marked, 3)}), list_concat({tilde(2)}, {tilde(3)})))"


# full cosines of all pairs, the best and the second best entry, the words of the chosen one
_MAPPED = f"""
WITH asked AS (SELECT case_id, {_plain_sql('input')} AS value FROM test_cases WHERE kind = 'lookup' AND trim(input) <> ''),
entries AS (SELECT {_plain_sql('name')} AS entry, min(pid) AS pid FROM catalog_items GROUP BY 1),
vals AS (SELECT DISTINCT value FROM asked WHERE value <> ''),
vg AS (SELECT value, unnest({_grams_sql('value')}) AS gram FROM vals),
eg AS (SELECT pid, unnest({_grams_sql('entry')}) AS gram FROM entries),
sizes AS (SELECT (SELECT count(*) FROM entries) AS n, (SELECT count(*) FROM vals) AS v),
held AS (SELECT gram, count(*) AS held FROM eg GROUP BY 1), seen AS (SELECT gram, count(*) AS seen FROM vg GROUP BY 1),
w AS (SELECT coalesce(held.gram, seen.gram) AS gram, sqrt(least(ln(1 + n / CAST(coalesce(held, 1) AS DOUBLE)), ln(1 + (v + n) / CAST(coalesce(seen, 1) AS DOUBLE)))) AS w
  FROM held FULL JOIN seen ON held.gram = seen.gram, sizes),
x AS (SELECT value, gram, w / sqrt(sum(w * w) OVER (PARTITION BY value)) AS x FROM vg JOIN w USING (gram)),
y AS (SELECT pid, gram, w / sqrt(sum(w * w) OVER (PARTITION BY pid)) AS y FROM eg JOIN w USING (gram)),
cosines AS (SELECT value, pid, sum(x * y) AS c FROM x JOIN y USING (gram) GROUP BY ALL),
ranked AS (SELECT value, pid, c, coalesce(lead(c) OVER (PARTITION BY value ORDER BY c DESC), 0) AS nxt, row_number() OVER (PARTITION BY value ORDER BY c DESC) AS r FROM cosines),
chosen AS (SELECT value, pid FROM ranked WHERE r = 1 AND c >= 0.3 AND c - nxt >= 0.06),
entry_words AS (SELECT pid, entry, unnest(list_distinct(string_split(entry, ' '))) AS word FROM entries),
words AS (SELECT word, count(*) > greatest((SELECT n FROM sizes) / 4.0, 1) AS shared FROM entry_words GROUP BY 1),
own AS (SELECT pid, word, shared, bool_and(shared) OVER (PARTITION BY pid) AS only_shared FROM entry_words JOIN words USING (word)),
wanted AS (SELECT pid, {_grams_sql('word')} AS g FROM own WHERE only_shared OR NOT shared),
covered AS (SELECT value, pid FROM chosen JOIN wanted USING (pid) GROUP BY ALL HAVING bool_and(len(list_intersect(g, {_grams_sql('value')})) >= 0.25 * len(g))),
mapped AS (SELECT case_id, value, coalesce(pid, -1) AS pid FROM asked LEFT JOIN covered USING (value))
"""

_WORDS = """
WITH doc_words AS (SELECT doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
item_words AS (SELECT item_id AS id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM eval_items),
item_runs AS (SELECT DISTINCT id AS item_id, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM item_words)),
doc_runs AS (SELECT id AS doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM doc_words)),
met AS (SELECT doc_id, item_id, count(*) AS runs FROM doc_runs JOIN item_runs USING (run) GROUP BY ALL)
"""

ORACLE = {
    "p1_found": _MAPPED + "SELECT case_id, pid FROM mapped",
    "p1_unmatched": _MAPPED + "SELECT value AS input_form, count(*) AS cases FROM mapped WHERE pid = -1 GROUP BY 1",
    "p2_found": _ITEM_TERMS + "SELECT item_key, term FROM tf JOIN st USING (term) WHERE records BETWEEN 2 AND 6",
    "p2_weights": _ITEM_TERMS
    + """SELECT item_key, term, tf, records, round(ln(1 + tf) * greatest(0, 1 - (ln(occ) - spread / occ) / ln((SELECT count(*) FROM live))), 6) AS weight
    FROM tf JOIN st USING (term)""",
    "p4_found": _SETS + "SELECT x AS item_key_a, y AS item_key_b FROM pairs",
    "p4_classes": _SETS
    + """, sets AS (SELECT item_key, list(f ORDER BY f) AS fs FROM filled GROUP BY 1 HAVING count(*) >= 3),
    links AS (SELECT k, count(*) AS links FROM (SELECT x AS k FROM pairs UNION ALL SELECT y FROM pairs) GROUP BY 1)
    SELECT item_key, min(item_key) OVER (PARTITION BY fs) AS class_id, coalesce(links, 0) AS links FROM sets LEFT JOIN links ON k = item_key""",
    "p5_found": _COUNTED + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p6_found": _WORDS + "SELECT doc_id, item_id FROM met",
    "p6_items": _WORDS
    + r""", answers AS (SELECT item_id, trim(regexp_replace(lower(regexp_replace(text, '^.*?(?:^|\n)[^\S\n]*(?:answer|solution|example)[^\S\n]*:', '', 'is')), '[^\p{L}\p{N}]+', ' ', 'g')) AS answer
      FROM eval_items WHERE regexp_matches(text, '(?:^|\n)[^\S\n]*(?:answer|solution|example)[^\S\n]*:', 'i'))
    SELECT item_id, count(*) AS documents, max(runs) AS longest, count(*) FILTER (answer <> '' AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || answer || ' ')) AS answers
    FROM met JOIN doc_words ON id = doc_id LEFT JOIN answers USING (item_id) GROUP BY 1""",
    # characters for tokens: the sources are far enough from their limits
    "p7_found": """
WITH sized AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1),
named AS (SELECT t.source, weight, max_repeats, coalesce(n, 0) AS n FROM mix_targets t LEFT JOIN sized USING (source))
SELECT source FROM named WHERE n * max_repeats < weight * (SELECT sum(n) FROM named)""",
    "p5_counts": _COUNTED + "SELECT field, dense_rank() OVER (ORDER BY term) - 1 AS term_id, term, occurrences, records, mark FROM marked",
}
