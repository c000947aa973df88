"""All similar pairs between set-valued records: T-occurrence list merging.

Equal sets are folded into one class first. A class is sent to the partition of each token of its prefix,
the n - ceil(t n) + 1 tokens that come first in one global order, rarest first: two sets whose Jaccard
similarity reaches t share such a token, and the pair is emitted by the first token they share, once. The
classes of one token are its block; over a block stand inverted lists of all their tokens, and each class
probes those of its own: the shorter lists are merged on a heap that skips ahead, the longest are only
searched by bisection, and whatever reaches the required overlap is compared exactly.

How rare a token is comes from a table of counts by a hash of the token, BUCKETS of them at any size of the data, in one
byte each; tokens of one bucket stand together in the order. A token alone in its bucket belongs to one class only and
is not sent. Any order gives the same pairs; this one keeps blocks small.

A token with more than BLOCK classes is split into parts, and each pair of parts is a block of its own, so
no task ever holds more than about two parts. Nothing is capped: all pairs of parts are joined. Likewise members of a
class beyond MEMBERS are split into parts where pairs of records are asked for.

Defined cases: null lists, null and empty elements, and repeats don't count; sets of fewer than `least`
elements take no part; equal sets are similar; an empty table gives no pairs; columns other than the key and
the list are ignored. Keys are expected to be unique and not null; rows with a null key are left out.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilery.plans.session import durable

#: Classes of one token that are merged at once; members of a class in one part.
BLOCK, MEMBERS = 1500, 10_000
#: Counts of tokens by their hash: what is gathered and broadcast has this size at most.
BUCKETS = 1 << 22
#: Split tokens or classes up to so many are broadcast, more are joined in a shuffle.
BROADCAST_ROWS = 100_000


def merge_skip(lists: list[list[int]], wanted: int, below: int) -> list[int]:
    """Positions under `below` that stand in at least `wanted` of the ascending lists.

    The L longest lists, L = wanted / (0.01 * log2 of the longest + 1), are set aside and searched by bisection; the
    others are merged on a heap for positions met wanted - L times, skipping what can't be met that often.
    """
    lists = sorted((x for x in lists if x), key=len, reverse=True)
    if len(lists) < wanted:
        return []
    aside = min(wanted - 1, int(wanted / (0.01 * log2(len(lists[0]) + 1) + 1)))
    long, short, need = lists[:aside], lists[aside:], wanted - aside
    heap = [(x[0], i, 0) for i, x in enumerate(short) if x[0] < below]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            met = len(popped)
            for x in long:
                at = bisect_left(x, top)
                met += at < len(x) and x[at] == top
            if met >= wanted:
                found.append(top)
            target = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(short[i], target, at)
            if at < len(short[i]) and short[i][at] < below:
                heapq.heappush(heap, (short[i][at], i, at))
    return found


def similar_in_block(token: int, sets: list[list[int]], parts: list[int], two: bool, share: Fraction) -> list[tuple[int, int, int]]:
    """(i, j, overlap) of the pairs of a block whose first shared token, in the order of the sets, is `token`.
    In a block of two parts only pairs of different parts count."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    lists: dict[int, list[int]] = {}
    rank, out = [], []
    for at, i in enumerate(order):
        own = sets[i]
        least = -(-share.numerator * len(own) // share.denominator)
        probe = [lists[x] for x in own if x in lists]
        for j in merge_skip(probe, max(least, 1), at):
            other = rank[j]
            if two and parts[other] == parts[i]:
                continue
            theirs = set(sets[other])
            common = [x for x in own if x in theirs]
            both = len(own) + len(theirs) - len(common)
            if common[0] == token and len(common) * share.denominator >= share.numerator * both:
                out.append((other, i, len(common)))
        rank.append(i)
        for x in own:
            lists.setdefault(x, []).append(at)
    return out


def set_classes(records: DataFrame, key: str, elements: str, least: int = 1) -> DataFrame:
    """(key, class_id, tokens), by these names: the set of each record as sorted 64-bit tokens, and a 128-bit id of the set.

    Two different elements with one token would have to meet within one pair of records to matter."""
    filled = F.filter(F.col(elements), lambda x: x.isNotNull() & (x != ""))
    tokens = F.array_sort(F.array_distinct(F.transform(filled, lambda x: F.xxhash64(x))))
    return (
        records.where(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), tokens.alias("tokens"))
        .where(F.size("tokens") >= least)
        .withColumn("class_id", F.unhex(F.md5(F.concat_ws(",", F.col("tokens").cast("array<string>")))))
    )


def grade(n: int) -> int:
    """A count from 1 on in one byte, by its logarithm; 0 is a single one."""
    return 0 if n < 2 else min(255, 1 + floor(8 * log2(n)))


def token_grades(classes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The grade of how many (class, token) rows each bucket of tokens has."""
    counts = classes.select(F.explode("tokens").alias("token")).groupBy(F.pmod("token", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    graded = F.least(F.lit(255), 1 + F.floor(8 * F.log2("n"))).cast("int")
    rows = counts.where("n > 1").select("bucket", graded.alias("grade")).toArrow()
    out = np.zeros(buckets, np.uint8)
    out[np.asarray(rows["bucket"])] = np.asarray(rows["grade"])
    return out


def prefixes(lists: pa.Array, grades: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, token, grade) of the prefix tokens of lists that more than one class may have, and the lists in the
    global order."""
    flat = np.asarray(lists.flatten())
    offsets = np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    row, grade_of = np.repeat(np.arange(len(size)), size), grades[flat % len(grades)]
    order = np.lexsort((flat, grade_of, row))
    flat, grade_of = flat[order], grade_of[order]
    prefix = size - -(-share.numerator * size // share.denominator) + 1
    sent = np.flatnonzero((np.arange(len(flat)) - offsets[row] < prefix[row]) & (grade_of > 0))
    return row[sent], flat[sent], grade_of[sent], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _small(frame: DataFrame) -> tuple[DataFrame, int]:
    """The frame, to be broadcast if it is small enough, and its size."""
    frame = durable(frame)
    n = frame.count()
    return (F.broadcast(frame) if n <= BROADCAST_ROWS else frame), n


def _every(parts: Column) -> Column:
    """A row for each part."""
    return F.explode(F.sequence(F.lit(0), parts - 1))


def similar_classes(classes: DataFrame, share: Fraction, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """(class_a, class_b, overlap, union_size) of all pairs of different classes (class_id, tokens) with a Jaccard
    similarity of at least `share`."""
    spark = classes.sparkSession
    counted = token_grades(classes, buckets)
    crowded = bool((counted >= grade(block)).any())
    grades = spark.sparkContext.broadcast(counted)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, full = grades.value, grade(block)
        for batch in batches:
            row, token, graded, lists = prefixes(batch.column("tokens"), known, share)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(graded >= full), batch.column("class_id").take(pa.array(row)), lists.take(pa.array(row))],
                names=["token", "crowded", "class_id", "tokens"],
            )

    sent = classes.select("class_id", "tokens").mapInArrow(send, "token bigint, crowded boolean, class_id binary, tokens array<bigint>")
    split = 0
    if crowded:
        sizes = sent.where("crowded").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > block)
        sizes, split = _small(sizes.select(F.col("token").alias("key"), F.lit(True).alias("crowded"), F.ceil(F.col("n") / block).cast("int").alias("parts")))
    if split:
        # rows that aren't crowded keep apart by their class: they find no match here
        spread = F.when(F.col("crowded"), F.col("token")).otherwise(F.xxhash64("class_id"))
        sent = sent.withColumn("key", spread).join(sizes, ["key", "crowded"], "left")
        parts = F.coalesce("parts", F.lit(1))
        sent = sent.select("token", "class_id", "tokens", parts.alias("parts"), F.pmod(F.xxhash64("class_id"), parts).cast("int").alias("part"))
        sent = sent.select("*", _every(F.col("parts")).alias("other"))
        pair = F.least("part", "other").cast("bigint") * F.col("parts") + F.greatest("part", "other")
        # in a block of one part all of it is compared, in one of two parts only what stands in different ones
        side = F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part"))
        sent = sent.select("token", pair.alias("block"), side.cast("bigint").alias("part"), "class_id", "tokens")
    else:
        sent = sent.select("token", F.lit(0).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("part"), "class_id", "tokens")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                sets, parts = [x[4] for x in held], [x[2] for x in held]
                for i, j, common in similar_in_block(held[0][0], sets, parts, parts[0] >= 0, share):
                    a, b = sorted((held[i][3], held[j][3]))
                    found.append((a, b, common, len(sets[i]) + len(sets[j]) - common))

        def rows() -> pa.RecordBatch:
            columns = zip(*found)
            types = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["class_a", "class_b", "overlap", "union_size"]
            )

        for batch in batches:
            token, part_block = np.asarray(batch.column("token")), np.asarray(batch.column("block"))
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (part_block[1:] != part_block[:-1])
            edges = [*np.flatnonzero(new).tolist(), len(token)]
            for first, last in zip(edges[:-1], edges[1:]):
                joins = first == 0 and held and held[0][:2] == (int(token[0]), int(part_block[0]))
                if not joins:
                    close()
                    held.clear()
                    if last - first == 1 and last < len(token):
                        continue  # alone with its token
                held.extend(zip(*(c.to_pylist() for c in batch.slice(first, last - first).columns)))
            if len(found) > 20_000:
                yield rows()
                found.clear()
        close()
        if found:
            yield rows()

    blocks = sent.repartition("token", "block").sortWithinPartitions("token", "block")
    return blocks.mapInArrow(merge, "class_a binary, class_b binary, overlap bigint, union_size bigint")


def _folded(records: DataFrame, key: str, elements: str, least: int) -> tuple[DataFrame, DataFrame]:
    members = durable(set_classes(records, key, elements, least))
    classes = durable(members.groupBy("class_id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("members"), F.min("key").alias("least")))
    return members.select("key", "class_id"), classes


def similar_pairs(records: DataFrame, key: str, elements: str, share: Fraction, least: int = 1, split: int = MEMBERS) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of records whose sets have at least `least` elements each and
    a Jaccard similarity of at least `share`, pairs of equal sets included."""
    members, classes = _folded(records, key, elements, least)
    links = similar_classes(classes, share).select("class_a", "class_b")
    large, n = _small(classes.where(F.col("members") > split).select("class_id", F.ceil(F.col("members") / split).cast("int").alias("parts")))
    several = classes.where(F.col("members") > 1).select("class_id")
    if n:
        # members of a large class stand in parts, and whatever meets it goes to each of them
        in_parts = lambda f, c: f.join(large.withColumnRenamed("class_id", c), c, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        members = in_parts(members, "class_id").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        for c, part in (("class_a", "part_a"), ("class_b", "part_b")):
            links = in_parts(links, c).withColumn(part, _every(F.col("parts"))).drop("parts")
    else:
        members = members.withColumns({"parts": F.lit(1), "part": F.lit(0)})
        links = links.withColumns({"part_a": F.lit(0), "part_b": F.lit(0)})
    a = members.select(F.col("key").alias("x"), F.col("class_id").alias("class_a"), F.col("part").alias("part_a"))
    b = members.select(F.col("key").alias("y"), F.col("class_id").alias("class_b"), F.col("part").alias("part_b"))
    across = links.join(a, ["class_a", "part_a"]).join(b, ["class_b", "part_b"]).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
    own = members.join(several, "class_id")
    # x of part p and y of part q meet in the block of p and q
    left = own.select("class_id", F.col("key").alias("x"), F.col("part").alias("p"), _every(F.col("parts")).alias("q"))
    right = own.select("class_id", F.col("key").alias("y"), F.col("part").alias("q"), _every(F.col("parts")).alias("p"))
    same = left.join(right, ["class_id", "p", "q"]).where(F.col("x") < F.col("y"))
    return across.unionByName(same.select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b")))


def similar_counts(records: DataFrame, key: str, elements: str, share: Fraction, least: int = 1) -> DataFrame:
    """(key, class_id, links): each record's class of equal sets, by the least key in it, and the number of other records
    similar to it."""
    members, classes = _folded(records, key, elements, least)
    links = similar_classes(classes, share).select("class_a", "class_b")
    both = links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    sizes = classes.select(F.col("class_id").alias("class_b"), "members")
    outer = both.join(sizes, "class_b").groupBy(F.col("class_a").alias("class_id")).agg(F.sum("members").alias("outer"))
    counts = classes.select("class_id", "members", "least").join(outer, "class_id", "left")
    counts = counts.select("class_id", "least", (F.col("members") - 1 + F.coalesce("outer", F.lit(0))).alias("links"))
    return members.join(counts, "class_id").select(F.col("key").alias(key), F.col("least").alias("class_id"), "links")
