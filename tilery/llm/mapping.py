"""Mapping free-entered values to a canonical list.

Values are normalised and deduplicated; an inverted index of the list by character n-grams retrieves candidates;
a weighted cosine scores them; the best entry is accepted if it reaches the threshold and leads the next entry by
the margin. Values that no entry is accepted for are reported with -1.

Features of a text are the 2- and 3-grams of its words with their ends marked, and those of the words without
their inner vowels, so that typing errors, dropped vowels, joined or divided words and another order of words leave most
of them standing. A feature weighs the root of its rarity, sqrt(ln(1 + n / entries that hold it)), or less
if it is commoner among the values than that: words that people put around what they ask for count little, as do
words that most entries share, without a list of either.

Candidates are bounded by the cosine: the features held by the most entries (a set S of at most BITS, each held by more
than one in COMMON) generate only pairs that could reach the threshold by them alone, |x_S| * |y_S| >= threshold. For all
others their part of the score is added where the other part can still reach the threshold with it. Nothing is lost by
it: the pairs and scores are those of the full cosine.

A caller whose list must have a thing as such may ask for a last check of what is accepted: of each distinctive word of the
entry, one that at most one in SHARED entries hold, the value must have the share `cover` of the features, so that
`waterproof bottle` isn't mapped to the only waterproof thing of the list. By default `new york` means New York City.

Defined cases: null and blank values are left out, others without letters and digits map to nothing; the same value
maps alike wherever it stands; ties are not accepted; an empty list maps everything to -1; entries of equal plain text
are one, with the least of their keys; entries with a null key or without letters and digits are left out; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from math import log

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilery.plans.session import durable

#: Least cosine of an accepted entry, and its least lead over the next one.
THRESHOLD, MARGIN = 0.3, 0.06
#: A feature that more than one in COMMON entries hold is common, of at most BITS of them.
COMMON, BITS = 8, 40
#: Words of more than one in SHARED entries may be missing in a value, whatever is asked of the others.
SHARED = 4
#: The index is broadcast up to so many (feature, entry) rows, and joined in a shuffle beyond.
BROADCAST_ROWS = 500_000
UNMATCHED = -1
#: Pairs this far below a bound are still looked at: sums are made in different orders.
SLACK = 1e-9


def plain(text: str) -> str:
    """Lower case without accents; one blank between words."""
    text = unicodedata.normalize("NFKD", text).lower()
    text = "".join(x for x in text if not unicodedata.combining(x))
    return " ".join("".join(x if x.isalnum() else " " for x in text).split())


@F.arrow_udf(T.StringType())
def plain_form(values: pa.Array) -> pa.Array:
    """`plain` of a column. ASCII stays in Arrow; each distinct other text goes through unicodedata once."""
    values = values.cast(pa.large_string())
    out = pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(values), pattern="[^a-z0-9]+", replacement=" "), characters=" ")
    other = pc.fill_null(pc.invert(pc.string_is_ascii(values)), False)
    if pc.any(other).as_py():
        coded = values.filter(other).dictionary_encode()
        own = pa.array([plain(x) for x in coded.dictionary.to_pylist()], pa.large_string())
        out = pc.replace_with_mask(out, other, own.take(coded.indices))
    return out.cast(pa.string())


def features(text: Column) -> Column:
    """The distinct n-grams of a plain text: of its words, ends marked by ^ and $, and behind a ~ of the words
    without vowels after their first letter."""
    marked = F.concat(F.lit("^"), F.replace(text, F.lit(" "), F.lit("$ ^")), F.lit("$"))
    bare = F.regexp_replace(text, r"(?<=\S)[aeiou]", "")
    grams = lambda x, n: F.regexp_extract_all(x, F.lit(rf"(?=(\S{{{n}}}))"), F.lit(1))
    tilde = lambda x: F.transform(x, lambda g: F.concat(F.lit("~"), g))
    return F.array_distinct(F.concat(grams(marked, 2), grams(marked, 3), tilde(grams(bare, 2)), tilde(grams(bare, 3))))


def _each(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.explode_outer("grams").alias("gram"))


def _weights(entries: DataFrame, values: DataFrame, n: int, v: int) -> DataFrame:
    """(gram, w, held): weights of the grams that don't have the full one, sqrt(ln(1 + n)), and of all that entries
    hold. A gram of the values only is among them if more than 1 in n texts hold it, so the table
    grows with the list, not with the values."""
    held = _each(entries, "entry_id").groupBy("gram").agg(F.count("*").alias("held"))
    seen = _each(values, "value_id").groupBy("gram").agg(F.count("*").alias("seen")).where(F.col("seen") > (v + n) / n)
    rarity = F.least(F.ln(1 + n / F.coalesce("held", F.lit(1))), F.ln(1 + (v + n) / F.coalesce("seen", F.lit(1))))
    return held.join(seen, "gram", "full").select("gram", F.sqrt(rarity).alias("w"), "held")


def retrieve(values: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """(value_id, entry_id, cosine) of all pairs of values (value_id, value) and entries (entry_id, entry), both of
    distinct plain texts, whose cosine is at least `least`."""
    spark = values.sparkSession
    entries = durable(entries.select("entry_id", features(F.col("entry")).alias("grams")))
    n, postings = entries.agg(F.count("*"), F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()
    kind = entries.schema["entry_id"].dataType
    if not n:
        return values.select("value_id", F.lit(None).cast(kind).alias("entry_id"), F.lit(0.0).alias("cosine")).where(F.lit(False))
    v = values.count()
    # partitioned by value: what follows needs no shuffle of the exploded rows while the index is broadcast
    values = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "value_id")
    values = values.select("value_id", features(F.col("value")).alias("grams"))
    small = postings <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda x: x
    weights = durable(_weights(entries, values, n, v))
    # features held by the most entries; the bits of one number say which of them a text has
    common = weights.where(F.col("held") > n / COMMON).orderBy(F.desc("held"), "gram").select("gram", "w").limit(BITS).collect()
    place = spark.createDataFrame([(r[0], 1 << i) for i, r in enumerate(common)], "gram string, bit bigint")
    weights = durable(weights.join(F.broadcast(place), "gram", "left"))
    square, rare = F.col("w") * F.col("w"), F.col("bit").isNull()
    mask = F.coalesce(F.bit_or("bit"), F.lit(0).cast("bigint"))
    length = lambda x: F.sqrt(F.coalesce(F.sum(x), F.lit(0.0)))

    rows = _each(entries, "entry_id").join(sent(weights), "gram")
    known = rows.groupBy("entry_id").agg(length(square).alias("size"), length(F.when(~rare, square)).alias("common"), mask.alias("bits"))
    known = durable(known.withColumn("common", F.col("common") / F.col("size")))
    most = known.agg(F.max("common")).first()[0]
    lists = rows.join(sent(known.select("entry_id", "size", "common")), "entry_id").select(
        "gram", "entry_id", (F.col("w") / F.col("size")).alias("y"), F.when(~rare, F.col("common")).alias("y_common")
    )

    weight = F.coalesce("w", F.lit(log(1 + n) ** 0.5))
    probe = F.struct("gram", weight.alias("w"))
    typed = _each(values, "value_id").join(sent(weights), "gram", "left").groupBy("value_id").agg(
        length(weight * weight).alias("x_size"), length(F.when(~rare, square)).alias("x_common"), mask.alias("x_bits"),
        F.collect_list(F.when(F.col("held").isNotNull() & rare, probe)).alias("rare"), F.collect_list(F.when(~rare, probe)).alias("often"),
    )
    typed = typed.withColumn("x_common", F.col("x_common") / F.col("x_size"))
    could = F.col("x_common") * most >= least - SLACK
    typed = typed.select("value_id", "x_size", "x_common", "x_bits", F.explode(F.when(could, F.concat("rare", "often")).otherwise(F.col("rare"))).alias("g"))
    typed = typed.select("value_id", "x_size", "x_common", "x_bits", (F.col("g.w") / F.col("x_size")).alias("x"), F.col("g.gram").alias("x_gram"))
    by_common = lambda y: F.col("x_common") * y >= least - SLACK
    hits = typed.join(sent(lists), (F.col("x_gram") == F.col("gram")) & (F.col("y_common").isNull() | by_common(F.col("y_common"))))
    dots = hits.groupBy("value_id", "entry_id", "x_size", "x_common", "x_bits").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    whole = by_common(F.col("common"))
    pairs = dots.join(sent(known), "entry_id").where(F.col("dot") + F.when(whole, 0.0).otherwise(F.col("x_common") * F.col("common")) >= least - SLACK)
    both = F.when(whole, 0.0).otherwise(_sum_of_bits(F.col("x_bits").bitwiseAND(F.col("bits")), [r[1] ** 2 for r in common]))
    scored = pairs.select("value_id", "entry_id", (F.col("dot") + both / (F.col("x_size") * F.col("size"))).alias("cosine"))
    return scored.where(F.col("cosine") >= least)


def _sum_of_bits(bits: Column, worth: list[float]) -> Column:
    """The sum of the worths of the bits that are set, by a table of the sums of each byte."""
    out = F.lit(0.0)
    for first in range(0, len(worth), 8):
        own = worth[first : first + 8]
        table = F.array(*[F.lit(float(sum(w for i, w in enumerate(own) if byte >> i & 1))) for byte in range(1 << len(own))])
        out += F.get(table, F.shiftright(bits, first).bitwiseAND(F.lit(255)).cast("int"))
    return out


def _asked_words(entries: DataFrame) -> DataFrame:
    """(entry_id, asked): the features of every distinctive word of an entry, or of every word if none is."""
    words = entries.select(F.explode(F.array_distinct(F.split("entry", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # at most SHARED times the words of a mean entry
    shared = [r[0] for r in words.where(F.col("n") > max(entries.count() / SHARED, 1)).collect()]
    own = F.split("entry", " ")
    distinctive = F.filter(own, lambda w: ~w.isin(shared)) if shared else own
    return entries.select("entry_id", F.transform(F.when(F.size(distinctive) > 0, distinctive).otherwise(own), features).alias("asked"))


def _covered(chosen: DataFrame, entries: DataFrame, cover: float) -> DataFrame:
    """The rows (value, entry_id) whose value has enough features of every word that its entry asks for."""
    # a list of one, so that the features of a value are made once and not again for every word
    enough = F.exists(F.array(features(F.col("value"))), lambda grams: F.forall("asked", lambda w: F.size(F.array_intersect(w, grams)) >= cover * F.size(w)))
    return chosen.join(_asked_words(entries), "entry_id").where(enough).drop("asked")


def map_values(
    values: DataFrame, key: str, value: str, entries: DataFrame, entry_key: str, entry_name: str,
    threshold: float = THRESHOLD, margin: float = MARGIN, cover: float = 0.0,
) -> DataFrame:
    """(key, entry_key, cosine): the entry each value means, or UNMATCHED and null."""
    typed = durable(values.where(F.col(value).rlike(r"(?U)\S")).select(F.col(key).alias("id"), plain_form(value).alias("value")))
    listed = entries.select(F.col(entry_key).alias("entry_id"), plain_form(entry_name).alias("entry"))
    listed = listed.where((F.col("entry") != "") & F.col("entry_id").isNotNull()).groupBy("entry").agg(F.min("entry_id").alias("entry_id"))
    listed = durable(listed)
    texts = durable(typed.select("value").where(F.col("value") != "").distinct().withColumn("value_id", F.monotonically_increasing_id()))
    # a second entry below threshold - margin is no rival to one that is accepted
    scored = retrieve(texts, listed, max(threshold - margin, 1e-9))
    order = Window.partitionBy("value_id").orderBy(F.desc("cosine"), "entry_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)
    first = F.max_by(F.struct("entry_id", "cosine"), F.col("cosine") - F.col("rank"))
    ranked = best.groupBy("value_id").agg(first.alias("best"), F.max(F.when(F.col("rank") == 2, F.col("cosine"))).alias("next"))
    clear = (F.col("best.cosine") >= threshold) & (F.col("next").isNull() | (F.col("best.cosine") - F.col("next") >= margin))
    chosen = ranked.where(clear).select("value_id", "best.entry_id", "best.cosine").join(texts, "value_id")
    if cover > 0:
        chosen = _covered(chosen, listed, cover)
    chosen = chosen.select("value", "entry_id", "cosine")
    kind = entries.schema[entry_key].dataType
    return typed.join(chosen, "value", "left").select(
        F.col("id").alias(key), F.coalesce("entry_id", F.lit(UNMATCHED).cast(kind)).alias(entry_key), "cosine"
    )
