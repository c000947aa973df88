"""How distinctive a term is per record: log-entropy weighting by two SQL aggregations.

weight = ln(1 + tf) * (1 - H / ln N), where tf is how often the record holds the term, H the entropy of the
term's occurrences over the records, and N the number of records. A term spread evenly over all records
weighs 0; one that a single record holds weighs ln(1 + tf).

Defined cases: null and empty term lists give no rows but count as records; null terms don't count; repeats
raise tf; rows of one key are one record (so are all rows with a null key); with a single record, entropy is
0 and every term is fully distinctive; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term held by more than one in HOT_SHARE records is hot. Of such terms there are at most HOT_SHARE times
#: the mean number of distinct terms of a record, whatever the size of the collection.
HOT_SHARE = 2000


def log_entropy(
    records: DataFrame,
    key: str,
    terms: str,
    within: tuple[str, ...] = (),
    min_records: int = 1,
    max_records: int | None = None,
) -> DataFrame:
    """(key, term, tf, records, weight) for the terms that min_records to max_records records hold.

    `within` names columns by which `records` is already partitioned and that the key determines: counting tf
    then needs no shuffle. The statistics of hot terms, of which there are few at any size, are broadcast;
    all other terms meet theirs in a shuffle without hot keys.
    """
    n = records.select(*within, key).distinct().count()
    parts = [f"__{i}" for i in range(len(within))]
    named = [F.col(c).alias(p) for c, p in zip(within, parts)]
    tf = (
        records.select(*named, F.col(key).alias("__key"), F.explode(terms).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(*parts, "__key", "term")
        .agg(F.count("*").alias("tf"))
        .select("__key", "term", "tf")
    )
    stats = tf.groupBy("term").agg(
        F.count("*").alias("records"),
        F.sum("tf").alias("occurrences"),
        F.sum(F.col("tf") * F.ln("tf")).alias("spread"),
    )
    asked = F.col("records") >= min_records
    if max_records is not None:
        asked &= F.col("records") <= max_records
    limit = max(n // HOT_SHARE, 1000)
    hot = F.broadcast(stats.where(F.col("records") > limit))
    cold = stats.where((F.col("records") <= limit) & asked)
    joined = tf.join(hot.select("term"), "term", "left_anti").join(cold, "term")
    if max_records is None or max_records > limit:
        joined = joined.unionByName(tf.join(hot.where(asked), "term"))
    entropy = F.ln("occurrences") - F.col("spread") / F.col("occurrences")
    even = F.ln(F.lit(float(max(n, 2))))
    return joined.select(
        F.col("__key").alias(key), "term", "tf", "records", (F.ln(1.0 + F.col("tf")) * F.greatest(F.lit(0.0), 1 - entropy / even)).alias("weight")
    )
