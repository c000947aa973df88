"""Evaluation texts leaking into training text: BM25 index of the test items, searched by block-max WAND.

The test items are the indexed side. Every document is read whole, as overlapping passages of PASSAGE words whose
overlap of RUN - 1 words keeps any run of RUN words in one passage. A passage is a query; the index returns all items
whose BM25 score reaches the item's threshold, which is the least score that RUN consecutive words of the item can
have. So no item that shares such a run with the passage can be missed. What is retrieved is then verified: a
run of RUN words of the item must stand in the passage, word by word. Of an item that holds a question and an answer (behind a
line that begins with one of ANSWERS) it is also verified what leaked: how many words of the question stand in shared
runs, and whether the document has the answer, all its words in order.

An index has at most MAX_ITEM_CHARS characters of items, or a single larger item. Items of any number are packed into
such parts as they come; all parts pass by the same buffered documents, which are read once.

Defined cases: null and empty texts leak nothing; items shorter than RUN words can't be leaked; repeated items
and documents are each reported; an empty table gives no rows; columns other than key and text are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilery.functions.text import flat

RUN, PASSAGE, BLOCK = 13, 64, 16
#: What begins the answer of an item.
ANSWERS = ("answer", "solution", "example")
#: Characters of items in one index, which is made on the driver and broadcast; and of documents that wait for all indexes.
MAX_ITEM_CHARS, MAX_WAITING = 8_000_000, 32_000_000
_K1, _B = 1.2, 0.75
_ANSWER = re.compile(rf"^[^\S\n]*(?:{'|'.join(ANSWERS)})[^\S\n]*:", re.I | re.M)


def words_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words (runs of letters and digits, lower case) of all texts, and the row of each."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, row = flat(pc.split_pattern_regex(lower, pattern=r"[^\p{L}\p{N}]+"))
    filled = pc.greater(pc.binary_length(words), 0)
    return words.filter(filled), row.filter(filled)


class ItemIndex:
    """Posting lists of impacts with the maxima of their blocks, item thresholds, and the words to verify.

    An impact is the BM25 weight of a word in an item divided by the item's threshold, so a passage retrieves
    an item where the impacts of their common words sum to 1 or more.
    """

    def __init__(self, keys: list, texts: list[str], run: int = RUN, block: int = BLOCK, kind: str = "bigint"):
        self.run, self.kind, self.block = run, kind, block
        cut = [m.end() if (m := _ANSWER.search(t)) else len(t) for t in texts]
        # the words before an answer, then those of the answer: their places say which are which
        parts = [x for t, at in zip(texts, cut) for x in (t[:at], t[at:])]
        words, part = words_of(pa.array(parts, pa.string()))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        codes, item = np.asarray(coded.indices).astype(np.int64), np.asarray(part).astype(np.int64) // 2
        length = np.bincount(item, minlength=len(keys))
        kept = length >= run
        answers = np.bincount(np.asarray(part)[np.asarray(part) % 2 == 1] // 2, minlength=len(keys))[kept]
        codes, item = codes[kept[item]], (np.cumsum(kept) - 1)[item[kept[item]]]
        self.keys, length = [k for k, keep in zip(keys, kept) if keep], length[kept]
        self.codes, self.first = codes.astype(np.int32), np.append(0, np.cumsum(length))
        self.answer = self.first[1:] - answers
        size, n = max(len(self.vocabulary), 1), len(self.keys)

        held, own, tf = np.unique(item * size + codes, return_inverse=True, return_counts=True)
        word, holder = held % size, held // size
        spread = np.bincount(word, minlength=size)[word]
        mean = length.mean() if n else 1.0
        weight = np.log(1 + (n - spread + 0.5) / (spread + 0.5)) * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * length[holder] / mean))
        # the least score of a window: a word counts where it stands first in it
        before = np.full(len(codes), -1)
        order = np.argsort(own, kind="stable")
        again = np.flatnonzero(own[order[1:]] == own[order[:-1]])
        before[order[again + 1]] = order[again]
        start = np.flatnonzero(np.arange(len(codes)) + run <= self.first[1:][item])
        score = np.zeros(len(start))
        for i in range(run):
            score += weight[own[start + i]] * (before[start + i] < start)
        windows = np.append(0, np.cumsum(length - run + 1))[:-1]
        least = np.minimum.reduceat(score, windows) if n else score
        impact = weight / least[holder] * (1 + 1e-9)

        order = np.lexsort((holder, word))
        self._items, self._impacts, self._lists = holder[order], impact[order], np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))
        self.tops = np.zeros(len(self.vocabulary) + 1)
        np.maximum.at(self.tops, word, impact)
        self.runs, self.places = self._sorted_runs(item[start] if n else start, start)
        self._known: dict[int, tuple[list, list, list]] = {}

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """A hash of every run of the codes."""
        count = max(len(codes) - self.run + 1, 0)
        out = np.zeros(count, np.uint64)
        for i in range(self.run):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[i : i + count].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return out

    def _sorted_runs(self, item: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each item the hashes of its runs in order, and where they stand."""
        hashes = self.hashes(self.codes)[start] if len(start) else np.zeros(0, np.uint64)
        order = np.lexsort((start, hashes, item))
        cuts = np.searchsorted(item[order], np.arange(1, len(self.keys)))
        return np.split(hashes[order], cuts), np.split(start[order], cuts)

    def lists(self, word: int) -> tuple[list[int], list[float], list[float]]:
        """Items, impacts and block maxima of a word."""
        if word not in self._known:
            own = slice(self._lists[word], self._lists[word + 1])
            impacts = self._impacts[own]
            tops = np.maximum.reduceat(impacts, np.arange(0, len(impacts), self.block)) if len(impacts) else impacts
            self._known[word] = (self._items[own].tolist(), impacts.tolist(), tops.tolist())
        return self._known[word]

    def met(self, passage: np.ndarray, hashes: np.ndarray, whole: np.ndarray, item: int) -> list[tuple[int, int]]:
        """(place in the passage, place in the index) of the runs of an item in a passage; `whole` are the places
        of runs without unknown words. Hashes find them, the words decide."""
        runs, places = self.runs[item], self.places[item]
        at = np.searchsorted(runs, hashes[whole])
        out = []
        for i, k in zip(whole.tolist(), at.tolist()):
            while k < len(runs) and runs[k] == hashes[i]:
                if (self.codes[places[k] : places[k] + self.run] == passage[i : i + self.run]).all():
                    out.append((i, int(places[k])))
                    break
                k += 1
        return out

    def search(self, query: list[int]) -> list[int]:
        """Items that the distinct words of the query retrieve: block-max WAND with the fixed threshold 1.

        Lists stand in the order of their current item. The pivot is the first item at which the upper bounds of the
        lists before it reach 1; if the maxima of the current blocks can't, the lists skip beyond those blocks.
        """
        size = self.block
        items, impacts, block_tops = ({w: self.lists(w)[i] for w in query} for i in range(3))
        live = sorted([items[w][0], w, 0] for w in query if items[w])
        found = []
        while live:
            bound, pivot = 0.0, -1
            for at, (_, w, _) in enumerate(live):
                bound += self.tops[w]
                if bound >= 1:
                    pivot = at
                    break
            if pivot < 0:
                break
            target = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == target:
                pivot += 1
            block_bound, end = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else 1 << 60
            for item, w, at in live[: pivot + 1]:
                own, k = items[w], at // size
                while k < len(block_tops[w]) and own[min((k + 1) * size, len(own)) - 1] < target:
                    k += 1
                if k < len(block_tops[w]):
                    block_bound += block_tops[w][k]
                    end = min(end, own[min((k + 1) * size, len(own)) - 1] + 1)
            if block_bound < 1:
                advance = max(end, target + 1)
            elif live[0][0] == target:
                score = sum(impacts[w][at] for item, w, at in live[: pivot + 1])
                if score >= 1:
                    found.append(target)
                advance = target + 1
            else:
                advance = target
            moved = []
            for entry in live[: pivot + 1]:
                item, w, at = entry
                own = items[w]
                while at < len(own) and own[at] < advance:
                    at += 1
                if at < len(own):
                    moved.append([own[at], w, at])
            live = list(heapq.merge(sorted(moved), live[pivot + 1 :]))
        return found


def item_indexes(items: DataFrame, key: str, text: str, most: int | None = None, run: int = RUN, block: int = BLOCK) -> Iterator[ItemIndex]:
    """Indexes of at most `most` characters that together hold all items, filled in the order in which these come; an
    item above the limit has one of its own. The driver holds one part at a time."""
    most, kind = MAX_ITEM_CHARS if most is None else most, items.schema[key].dataType.simpleString()
    keys, texts, size, made = [], [], 0, False
    for own, said in items.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        if keys and size + len(said) > most:
            yield ItemIndex(keys, texts, run, block, kind)
            keys, texts, size, made = [], [], 0, True
        keys.append(own)
        texts.append(said)
        size += len(said)
    if keys or not made:
        yield ItemIndex(keys, texts, run, block, kind)


def _shares(words: pa.Array, rows: np.ndarray, index: ItemIndex, passage: int) -> Iterator[tuple[int, int, int, int, bool | None]]:
    """(row, item, runs in common, words of the question in them, whether the answer stands in the text) of the words of
    a batch of texts and the row of each."""
    run = index.run
    if not len(words):
        return
    codes = np.asarray(pc.fill_null(pc.index_in(words, value_set=index.vocabulary.cast(words.type)), -1)).astype(np.int32)
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    last = np.append(first[1:], len(rows))
    step = passage - run + 1
    counts = np.maximum(1, -(-(last - first - run + 1) // step))
    text = np.repeat(np.arange(len(first)), counts)
    start = np.repeat(first, counts) + step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    stop = np.minimum(start + passage, last[text])
    # the upper bound of a passage over all items, repeats included: below 1 WAND would find no pivot
    sums = np.append(0.0, np.cumsum(index.tops[codes]))
    known = np.append(0, np.cumsum(codes >= 0))
    hopeful = np.flatnonzero((sums[stop] - sums[start] >= 1 - 1e-6) & (known[stop] - known[start] >= run))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for p in hopeful.tolist():
        own = codes[start[p] : stop[p]]
        inside = own >= 0
        query = np.unique(own[inside])
        if index.tops[query].sum() < 1:
            continue
        gaps = np.append(0, np.cumsum(~inside))
        whole = np.flatnonzero(gaps[run:] == gaps[:-run])
        if not len(whole):
            continue
        retrieved = index.search(query.tolist())
        if not retrieved:
            continue
        hashes = index.hashes(own)
        for item in retrieved:
            for i, place in index.met(own, hashes, whole, item):
                found.setdefault((int(text[p]), item), {})[int(start[p]) + i] = place
    for (t, item), met in found.items():
        begin, end, answer = int(index.first[item]), int(index.first[item + 1]), int(index.answer[item])
        shared = np.zeros(end - begin, bool)
        for place in met.values():
            shared[place - begin : place - begin + run] = True
        yield int(rows[first[t]]), item, len(met), int(shared[: answer - begin].sum()), _holds(codes[first[t] : last[t]], index.codes[answer:end])


def _holds(codes: np.ndarray, wanted: np.ndarray) -> bool | None:
    """Whether the wanted codes stand among the codes, in order and next to each other; None if there are none."""
    if not len(wanted):
        return None
    at = np.flatnonzero(codes[: max(len(codes) - len(wanted) + 1, 0)] == wanted[0])
    for i in range(1, len(wanted)):
        at = at[codes[at + i] == wanted[i]]
    return bool(len(at))


_FOUND = "item_id {kind}, runs bigint, question bigint, answer boolean"


def leaked(documents: DataFrame, key: str, text: str, indexes: list[Broadcast], kind: str, passage: int = PASSAGE) -> DataFrame:
    """(key, item_id, runs, question, answer): the items each document leaks, at how many of its words a run of theirs starts,
    how many words of their question stand in such runs, and whether the document has their answer (null if they have none).

    Narrow: one pass over the documents, no shuffle. With several indexes documents wait for all of them, up to MAX_WAITING
    characters at a time."""
    own = documents.schema[key].dataType.simpleString()
    names = ["key", "item_id", "runs", "question", "answer"]

    def look(keys: pa.Array, words: pa.Array, rows: np.ndarray, index: ItemIndex) -> Iterator[pa.RecordBatch]:
        met = list(_shares(words, rows, index, passage))
        if met:
            row, item, *counts = zip(*met)
            columns = [keys.take(pa.array(row)), pa.array([index.keys[i] for i in item])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(counts, (pa.int64(), pa.int64(), pa.bool_())))], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(indexes) == 1:
            index = cloudpickle.loads(indexes[0].value)
            for batch in batches:
                words, rows = words_of(batch.column("text"))
                yield from look(batch.column("key"), words, np.asarray(rows), index)
            return
        waiting, size = [], 0

        def pass_by() -> Iterator[pa.RecordBatch]:
            for shared in indexes:
                index = cloudpickle.loads(shared.value)
                # kept on the executor's disk, not in this process
                vars(shared).pop("_value", None)
                for keys, words, rows in waiting:
                    yield from look(keys, words, rows, index)

        for batch in batches:
            words, rows = words_of(batch.column("text"))
            waiting.append((batch.column("key"), words, np.asarray(rows)))
            size += pc.sum(pc.binary_length(words)).as_py() or 0
            if size > MAX_WAITING:
                yield from pass_by()
                waiting, size = [], 0
        if waiting:
            yield from pass_by()

    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(scan, f"key {own}, " + _FOUND.format(kind=kind)).withColumnRenamed("key", key)


def search_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, most: int | None = None, passage: int = PASSAGE) -> DataFrame:
    """`leaked` for items of any number and size."""
    if passage < 2 * RUN:
        raise ValueError("a passage must hold two runs")
    # as bytes: a broadcast object would need this package on the executors' path
    send = documents.sparkSession.sparkContext.broadcast
    indexes = [send(cloudpickle.dumps(index)) for index in item_indexes(items, item_key, item_text, most)]
    return leaked(documents, key, text, indexes, items.schema[item_key].dataType.simpleString(), passage)
