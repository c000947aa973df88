"""Several values packed in one field: one row per value, with its position kept.

The scanner works on the UTF-8 data buffer of an Arrow string array. Character classes are byte masks;
quote parity comes from run lengths and cumulative counts; the spans of the values give child offsets, from
which the child string array is gathered and flattened with the ordinals of its parents.

Two grammars are known:

``separated``  an unquoted value is a run of ASCII letters, digits, ``_``, ``-``, ``.`` and ``'`` that does
    not begin with ``'``; a value may instead be quoted by straight double, straight single or curly double
    quotes, where a doubled straight quote stands for one. Everything else outside quotes separates.
``bracketed``  a value is what stands between ``[`` and its ``]``, where a bracket inside a double-quoted
    stretch belongs to the value; outside brackets a run of ASCII letters, digits, ``_`` and ``:`` is a value.

Defined cases: null, empty and blank cells give no row; no value is empty; repeated values stay; an opening
quote (with its repeats) or bracket that is never closed in its cell separates, and reading goes on after it;
other columns of the input are not needed and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATED, BRACKETED = "separated", "bracketed"

_DOUBLE, _SINGLE, _CURLY = 1, 2, 3


def _class(extra: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    for first, last in ((b"0", b"9"), (b"A", b"Z"), (b"a", b"z")):
        mask[first[0] : last[0] + 1] = True
    mask[list(extra)] = True
    return mask


_WORD = _class(b"_-.")
_TOKEN = _class(b"_:")


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all cells one after the other, and the n + 1 offsets of the cells."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _next(sorted_positions: np.ndarray, after: np.ndarray, none: int) -> np.ndarray:
    """For each of `after` the first of the positions beyond it, or `none`."""
    at = np.searchsorted(sorted_positions, after, side="right")
    padded = np.append(sorted_positions, none)
    return padded[at]


def _chain(opens: np.ndarray, closes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which openings are real: read from the left, an opening inside an earlier span doesn't count.

    opens is ascending; closes[k] < 0 marks an opening without its close, which is no opening. All cells
    advance together; once few are left, they are walked one by one, so a huge cell costs linear time.
    """
    closed = closes >= 0
    opens, closes, cells = opens[closed], closes[closed], cells[closed]
    real = np.zeros(len(opens), dtype=bool)
    if len(opens):
        if np.all((opens[1:] > closes[:-1]) | (cells[1:] != cells[:-1])):
            real[:] = True
        else:
            follow = np.searchsorted(opens, closes, side="right")
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            last = np.append(first[1:], len(opens))
            at, end = first, last
            while len(at) > 64:
                real[at] = True
                at = follow[at]
                live = at < end
                at, end = at[live], end[live]
            steps = follow.tolist() if len(at) else []
            for a, e in zip(at.tolist(), end.tolist()):
                while a < e:
                    real[a] = True
                    a = steps[a]
    out = np.zeros(len(closed), dtype=bool)
    out[np.flatnonzero(closed)] = real
    return out


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a cell's border."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(mask) + 1, dtype=bool)
    border[offsets] = True
    before = np.append(False, mask[:-1])
    after = np.append(mask[1:], False)
    starts = np.flatnonzero(mask & (~before | border[:-1]))
    ends = np.flatnonzero(mask & (~after | border[1:])) + 1
    return starts, ends


def _covered(starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Bytes inside any of the disjoint spans [start, stop)."""
    edge = np.zeros(size + 1, dtype=np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _quoted(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and kind of each quoted span, quotes included."""
    size = len(raw)
    cell_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    found = []
    for kind, char in ((_DOUBLE, 0x22), (_SINGLE, 0x27)):
        run_start, run_end = _runs(raw == char, offsets)
        if not len(run_start):
            continue
        length = run_end - run_start
        odd = (length & 1).astype(bool)
        # parity: an even run opens and closes in itself; an odd one is closed by the next odd run of its cell
        odd_last = run_end[odd] - 1
        inner = _next(odd_last, run_end - 1, -1)
        close = np.where(odd, inner, run_end - 1)
        close = np.where((close >= 0) & (close < offsets[cell_of(run_start) + 1]), close, -1)
        if kind == _SINGLE:
            start_of_cell = np.isin(run_start, offsets)
            in_word = ~start_of_cell & _WORD[raw[np.maximum(run_start - 1, 0)]]
            run_start, close = run_start[~in_word], close[~in_word]
        found.append((run_start, close, np.full(len(run_start), kind)))
    lead = np.flatnonzero(raw == 0xE2)
    lead = lead[lead + 2 < size]
    lead = lead[raw[lead + 1] == 0x80]
    opening, closing = lead[raw[lead + 2] == 0x9C], lead[raw[lead + 2] == 0x9D]
    if len(opening):
        close = _next(closing, opening, -1)
        close = np.where((close >= 0) & (close < offsets[cell_of(opening) + 1]), close + 2, -1)
        found.append((opening, close, np.full(len(opening), _CURLY)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, close, kind = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start, kind="stable")
    start, close, kind = start[order], close[order], kind[order]
    real = _chain(start, close, cell_of(start))
    return start[real], close[real] + 1, kind[real]


def _separated(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, stop, kind = _quoted(raw, offsets)
    free = ~_covered(start, stop, len(raw)) if len(start) else np.ones(len(raw), dtype=bool)
    word = _WORD[raw] & free
    quote = (raw == 0x27) & free
    if quote.any():
        # an apostrophe belongs to the word before it
        run_start, run_end = _runs(quote, offsets)
        joined = (run_start > 0) & ~np.isin(run_start, offsets) & word[np.maximum(run_start - 1, 0)]
        if joined.any():
            word |= _covered(run_start[joined], run_end[joined], len(raw))
    word_start, word_stop = _runs(word, offsets)
    width = np.where(kind == _CURLY, 3, 1)
    return (
        np.concatenate([word_start, start + width]),
        np.concatenate([word_stop, stop - width]),
        np.concatenate([np.zeros(len(word_start), np.int64), kind]),
    )


def _bracketed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    opening, closing = np.flatnonzero(raw == 0x5B), np.flatnonzero(raw == 0x5D)
    if len(opening):
        parity = np.cumsum(raw == 0x22, dtype=np.int64) & 1
        cells = np.searchsorted(offsets, opening, side="right") - 1
        odd = parity[closing].astype(bool)
        close = np.where(parity[opening] == 1, _next(closing[odd], opening, -1), _next(closing[~odd], opening, -1))
        close = np.where((close >= 0) & (close < offsets[cells + 1]), close, -1)
        real = _chain(opening, close, cells)
        start, stop = opening[real], close[real] + 1
    else:
        start = stop = np.zeros(0, np.int64)
    free = ~_covered(start, stop, len(raw)) if len(start) else np.ones(len(raw), dtype=bool)
    word_start, word_stop = _runs(_TOKEN[raw] & free, offsets)
    return (
        np.concatenate([word_start, start + 1]),
        np.concatenate([word_stop, stop - 1]),
        np.zeros(len(word_start) + len(start), np.int64),
    )


def split_cells(texts: pa.Array, grammar: str) -> pa.Array:
    """The list of values of each cell."""
    raw, offsets = _buffer(texts)
    begin, end, kind = (_separated if grammar == SEPARATED else _bracketed)(raw, offsets)
    filled = end > begin
    begin, end, kind = begin[filled], end[filled], kind[filled]
    order = np.argsort(begin, kind="stable")
    begin, end, kind = begin[order], end[order], kind[order]
    length = end - begin
    child = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(length, out=child[1:])
    gather = np.repeat(begin - child[:-1], length) + np.arange(child[-1])
    values = pa.Array.from_buffers(
        pa.large_string(), len(begin), [None, pa.py_buffer(child.tobytes()), pa.py_buffer(raw[gather].tobytes())]
    )
    for which, char in ((_DOUBLE, '"'), (_SINGLE, "'")):
        if (kind == which).any():
            single = pc.replace_substring(values, pattern=char * 2, replacement=char)
            values = pc.if_else(pa.array(kind == which), single, values)
    # values stand in the order of the text, so those of a cell are a run: its bounds are the offsets of the lists
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(begin, offsets[: len(texts) + 1]), pa.int64()), values)


def flatten_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All values, the ordinal of each one's list, and its position from 0 in the list."""
    parent = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    return lists.flatten(), parent, np.arange(len(parent)) - (np.asarray(lists.offsets) - lists.offsets[0].as_py())[parent]


def split_packed(frame: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, pos, item_value): one row per value of each of the fields, by its grammar.

    Narrow: no shuffle, so a huge key group costs nothing more; memory is bounded by one Arrow batch.
    """
    kind = frame.schema[key].dataType
    source = frame.select(F.col(key).alias("key"), *(F.col(f).cast("string").alias(f"cell_{i}") for i, f in enumerate(fields)))
    plan = [(f"cell_{i}", field, grammar) for i, (field, grammar) in enumerate(fields.items())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for column, field, grammar in plan:
                values, parent, pos = flatten_lists(split_cells(batch.column(column), grammar))
                if len(values):
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(parent)),
                            pa.array([field]).take(pa.array(np.zeros(len(parent), np.int32))),
                            pa.array(pos.astype(np.int32)),
                            values.cast(pa.string()),
                        ],
                        names=["key", "field", "pos", "item_value"],
                    )

    out = source.mapInArrow(scan, f"key {kind.simpleString()}, field string, pos int, item_value string")
    return out.withColumnRenamed("key", key)
