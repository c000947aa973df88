"""Frequency of every distinct term: a global dictionary, blockwise count arrays, sums by range of identifiers.

A block (one Arrow batch of records) is encoded against its own dictionary and counted into two arrays, occurrences and
records holding the term. The dictionaries of all blocks make the global one: distinct terms, numbered densely
in their order. By it the blocks are encoded with global identifiers, and their arrays are summed by range of identifiers: the
owner of a range adds all blocks to two arrays of the range's width. Memory is bounded by a batch on one side and by the
width of a range on the other, and a term that all records hold arrives once per block only.

Defined cases: a null list or text is a record without terms unless the caller leaves it out; null and blank
elements hold no terms; repeats count as occurrences, not as records; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilery.functions.text import flat, normalise
from tilery.operators.numbering import number_rows
from tilery.plans.session import durable

#: Most identifiers of a range.
WIDTH = 1 << 20

_COUNTS = "field string, term string, occurrences bigint, records bigint"


def _count_block(lists: pa.Array, matcher: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of a block of records, with the arrays of their occurrences and records."""
    texts, record = flat(lists)
    words, text = flat(pc.split_pattern(pc.fill_null(normalise(texts, matcher), ""), pattern=" "))
    filled = pc.greater(pc.binary_length(words), 0)
    words, text = words.filter(filled), np.asarray(text.filter(filled))
    coded = words.dictionary_encode()
    codes, size = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
    holder = np.asarray(record)[text].astype(np.int64)
    held = np.unique(holder * max(size, 1) + codes)
    return coded.dictionary, np.bincount(codes, minlength=size), np.bincount(held % max(size, 1), minlength=size)


def count_blocks(texts: DataFrame, matchers: dict[str, bool]) -> DataFrame:
    """(field, term, occurrences, records): the dictionary of every block with its two count arrays."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, matcher in matchers.items():
                own = batch.column("texts").filter(pc.equal(batch.column("field"), field))
                if not len(own):
                    continue
                terms, occurrences, records = _count_block(own, matcher)
                if len(terms):
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(field, len(terms)), terms.cast(pa.string()), pa.array(occurrences), pa.array(records)],
                        names=["field", "term", "occurrences", "records"],
                    )

    return texts.select("field", "texts").mapInArrow(blocks, _COUNTS)


def sum_ranges(encoded: DataFrame, fields: list[str], size: int, width: int = WIDTH) -> DataFrame:
    """(field, term_id, occurrences, records) of encoded blocks (field number, term_id, occurrences, records), summed by
    ranges of identifiers below `size`: the owner of a range adds the blocks to two arrays as wide as the range."""
    tasks = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(min(tasks, size), -(-size // width), 1)
    width = max(-(-size // ranges), 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(fields), width), np.int64)
        base = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("term_id"))
            base = int(ids[0]) // width * width if base is None else base
            at = (np.asarray(batch.column("field")), ids - base)
            for own, name in zip(sums, ("occurrences", "records")):
                np.add.at(own, at, np.asarray(batch.column(name)))
        if base is not None:
            number, at = np.nonzero(sums[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fields, pa.string()).take(pa.array(number)), pa.array(at + base), pa.array(sums[0][number, at]), pa.array(sums[1][number, at])],
                names=["field", "term_id", "occurrences", "records"],
            )

    # a partition is a range: the partition's number is that of the range
    owned = encoded.repartitionById(ranges, (F.col("term_id") / width).cast("int"))
    return owned.mapInArrow(add, "field string, term_id bigint, occurrences bigint, records bigint")


def term_frequency(texts: DataFrame, matchers: dict[str, bool]) -> DataFrame:
    """(field, term_id, term, occurrences, records) of a table (field, texts array<string>), one row a record.

    `matchers` says of each field whether a leading matcher is cut off its texts; fields it doesn't name
    aren't counted. Identifiers are 0, 1, ... in the order of the terms of all counted fields.
    """
    fields = list(matchers)
    counts = durable(count_blocks(texts, matchers))
    terms = durable(number_rows(counts.select("term").distinct(), ["term"], "term_id"))
    number = F.array_position(F.array(*map(F.lit, fields)), F.col("field")) - 1
    encoded = counts.join(terms, "term").select(number.cast("int").alias("field"), "term_id", "occurrences", "records")
    return sum_ranges(encoded, fields, terms.count()).join(terms, "term_id").select("field", "term_id", "term", "occurrences", "records")


def mark_terms(counts: DataFrame, totals: DataFrame, rare: int = 2, common_share: float = 0.1) -> DataFrame:
    """Adds `mark`: rare if at most `rare` records hold the term, else common if more than `common_share` of
    the field's records do, else null. totals (field, n_records) has one row a field."""
    joined = counts.join(F.broadcast(totals), "field")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("n_records") * common_share, "common")
    return joined.withColumn("mark", mark).drop("n_records")
