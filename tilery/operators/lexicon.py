"""Lexicon and inverted index: domains of aliases, their terms, downstream terms, postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilery.functions.numbers import VOCABULARY, NumberGrammar
from tilery.functions.terms import TermModel, dictionary
from tilery.operators.expand import alias_matcher, alias_pattern, expand_pattern
from tilery.operators.numbering import number_rows

#: More domains than this are refused: each term carries the domains that it is downstream of.
MAX_DOMAINS = 1000


def alias_rows(items: DataFrame, domain_order: list[str] | None = None) -> DataFrame:
    """(domain, domain_ord, ord, alias_ord, expand_ord, pid, name, matcher, text): a row for each expanded text."""
    place = F.array_position(F.array(*map(F.lit, domain_order)), F.col("domain")) if domain_order else F.lit(0)
    expressions = items.select("domain", place.cast("int").alias("domain_ord"), "ord", "pid", "name", F.posexplode("aliases").alias("alias_ord", "expression"))
    expressions = expressions.where(F.col("expression").isNotNull())
    texts = F.posexplode(expand_pattern(alias_pattern(F.col("expression")))).alias("expand_ord", "text")
    return expressions.select("domain", "domain_ord", "ord", "alias_ord", "pid", "name", alias_matcher(F.col("expression")).alias("matcher"), texts)


def term_positions(frame: DataFrame, key: list[str], text: str, model: TermModel) -> DataFrame:
    """(key, pos, term) of every text."""
    return frame.select(*key, F.posexplode(model.breaks(F.trim(F.col(text)))).alias("pos", "term"))


def hashed(frame: DataFrame, key: list[str], text: str, model: TermModel, below: DataFrame | None = None) -> DataFrame:
    """(key, terms, stems, hashes): arrays in term order. Stemming and hashing see distinct terms only.

    With `below` (hash, domains) also `below`, for each term the domains it is downstream of: these are joined to the
    distinct terms, before they meet the texts."""
    rows = term_positions(frame, key, text, model)
    known, columns = dictionary(rows, "term", model), ["pos", "term", "stem", "hash"]
    if below is not None:
        known, columns = known.join(below, "hash", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>"))), [*columns, "domains"]
    joined = rows.join(known, "term")
    ordered = F.array_sort(F.collect_list(F.struct(*columns)))
    arrays = joined.groupBy(*key).agg(ordered.alias("t"))
    named = {"terms": "term", "stems": "stem", "hashes": "hash", "below": "domains"}
    return arrays.select(*key, *(F.col(f"t.{c}").alias(name) for name, c in named.items() if c in columns))


@dataclass
class Lexicon:
    """aliases: one row an alias, with its id, terms, stems and hashes, of ingested domains only.
    own: (domain, hash), the terms of every domain. number_terms: (hash) of number words. words: (term) of all domains.
    number_keys: the hash of each number word, by which numbers are read."""

    aliases: DataFrame
    own: DataFrame
    number_terms: DataFrame
    words: DataFrame
    model: TermModel
    number_keys: dict[str, int]

    def numbers(self) -> NumberGrammar:
        """The grammar of number words, over hashes: whatever stems alike reads alike."""
        return NumberGrammar(self.number_keys.get)

    def posting_rows(self) -> DataFrame:
        """(hash, alias_id): a row for each occurrence of a term in an alias."""
        return self.aliases.select("alias_id", F.explode("hashes").alias("hash"))

    def postings(self) -> DataFrame:
        """(hash, stem, alias_ids, frequency): one id per occurrence, in order of ids."""
        return postings(self.aliases)

    def downstream(self) -> DataFrame:
        """(domain, hash): number terms and the terms of all other domains."""
        return downstream_terms(self.own, self.number_terms)

    def below(self) -> DataFrame:
        """(hash, domains): the domains that each term is downstream of; never more than MAX_DOMAINS."""
        return self.downstream().groupBy("hash").agg(F.collect_set("domain").alias("domains"))

    def vocabulary(self) -> DataFrame:
        """(term): distinct raw terms of all domains and number words."""
        numbers = self.words.sparkSession.createDataFrame([(w,) for w in VOCABULARY], "term string")
        return self.words.unionByName(numbers).distinct()


def build_lexicon(items: DataFrame, domain_order: list[str], model: TermModel = TermModel(), not_ingested: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon of items (domain, ord, pid, name, aliases). Domains that are not ingested lend their terms, no aliases."""
    numbered = number_rows(alias_rows(items, domain_order), ["domain_ord", "ord", "pid", "alias_ord", "expand_ord"], "alias_id")
    arrays = hashed(numbered, ["alias_id"], "text", model)
    everything = numbered.join(arrays, "alias_id")
    own = everything.select("domain", F.explode("hashes").alias("hash")).distinct()
    words = everything.select(F.explode("terms").alias("term")).distinct()
    spoken = numbered.sparkSession.createDataFrame([(w,) for w in VOCABULARY], "term string")
    keys = {r["term"]: r["hash"] for r in dictionary(spoken, "term", model).collect()}
    numbers = numbered.sparkSession.createDataFrame([(h,) for h in sorted(set(keys.values()))], "hash bigint")
    ingested = everything.where(~F.col("domain").isin(*not_ingested)) if not_ingested else everything
    return Lexicon(ingested, own, numbers, words, model, keys)


def postings(aliases: DataFrame) -> DataFrame:
    """(hash, stem, alias_ids, frequency) of aliases (alias_id, stems, hashes)."""
    terms = aliases.select("alias_id", F.explode(F.arrays_zip("stems", "hashes")).alias("t")).select("alias_id", "t.*")
    return terms.groupBy(F.col("hashes").alias("hash")).agg(
        F.min_by("stems", "alias_id").alias("stem"),
        F.array_sort(F.collect_list("alias_id")).alias("alias_ids"),
        F.count("*").alias("frequency"),
    )


def downstream_terms(own: DataFrame, number_terms: DataFrame) -> DataFrame:
    """(domain, hash): a hash is downstream of a domain if another domain holds it, or if it is a number term.

    Domains are few; each hash is expanded to the domains it is downstream of, without comparing rows."""
    names = [r[0] for r in own.select("domain").distinct().limit(MAX_DOMAINS + 1).collect()]
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    every = F.array(*map(F.lit, sorted(names))) if names else F.array().cast("array<string>")
    holders = own.groupBy("hash").agg(F.collect_set("domain").alias("holders"))

    def elsewhere(domain: Column) -> Column:
        return F.exists(F.col("holders"), lambda h: h != domain)

    others = holders.select(F.explode(F.filter(every, elsewhere)).alias("domain"), "hash")
    numbers = number_terms.select(F.explode(every).alias("domain"), "hash")
    return others.unionByName(numbers).distinct()


def index_report(aliases: DataFrame) -> DataFrame:
    """(term, tokens, occurrences, alias_texts): for each term the number of distinct tokens and the aliases under it, in the
    order of most tokens first, then of the term."""
    terms = aliases.select("alias_id", "pid", "text", F.explode("stems").alias("term"))
    report = terms.groupBy("term").agg(
        F.count_distinct("pid").alias("tokens"), F.count("*").alias("occurrences"), F.array_sort(F.collect_set("text")).alias("alias_texts")
    )
    return report.orderBy(F.desc("tokens"), "term")


def stem_groups(words: DataFrame, word: str, stem: Column) -> DataFrame:
    """(stem, terms, n_terms): the distinct words of each stem; stems of several words are collisions."""
    own = words.select(stem.alias("stem"), F.col(word).alias("word")).distinct()
    return own.groupBy("stem").agg(F.array_sort(F.collect_list("word")).alias("terms"), F.count("*").alias("n_terms"))
