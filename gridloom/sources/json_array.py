"""One JSON array in a file of any size, or in ordered parts of one, read by many tasks.

Whether a comma ends an element depends on all that comes before it: whether it stands in a string,
and how deep.  A file is cut into byte ranges.  Every range is scanned on its own for each state it
may begin in (outside strings, inside one, inside one just after a backslash): how it would end, and
by how much the depth would change.  Running through the ranges, the states in which they do begin
follow from those small summaries, a row per range and RANGES rows at most; each range is then cut
at its commas of depth one.  An element belongs to the range in which it begins and is read to its
end, so a task reads its range and the rest of one element.

Bytes of UTF-8 that continue a character are never mistaken for JSON's own characters.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.joined import JoinedFile

#: Ranges that a file is cut into at most; those of larger files are longer.
RANGES = 65_536
#: States in which a range can begin.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
#: Bytes that are looked at together.
BLOCK = 4 << 20
_QUOTE, _SLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_CHANGE = np.zeros(256, np.int64)
_CHANGE[[ord("["), ord("{")]], _CHANGE[[ord("]"), ord("}")]] = 1, -1
_BLANK = b" \t\r\n"


class NoJsonArray(ValueError):
    """A file that is not one whole JSON array."""


def _real_quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Places of quotes that no backslash escapes, and whether what follows the data is escaped.

    ``escaped`` tells whether the first byte is.  A quote is real behind an even number of backslashes.
    """
    places = np.append(np.flatnonzero(data == _QUOTE), len(data))
    run = np.zeros(len(places), np.int64)  # backslashes right before
    behind = np.flatnonzero((places > 0) & (data[places - 1] == _SLASH)) if len(data) else np.zeros(0, np.int64)
    if len(behind):
        others = np.flatnonzero(data != _SLASH)
        i = np.searchsorted(others, places[behind]) - 1
        run[behind] = places[behind] - 1 - (np.where(i >= 0, others[np.maximum(i, 0)], -1) if len(others) else -1)
    odd = (run + (escaped & (run == places))) % 2 == 1  # a run from the first byte on continues the one before the data
    return places[:-1][~odd[:-1]], bool(odd[-1])


def _structure(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places outside strings that open, close or separate, the change of depth at each, and the state behind the data."""
    quotes, escaped = _real_quotes(data, state == ESCAPED)
    places = np.flatnonzero((_CHANGE[data] != 0) | (data == _COMMA))
    inside = (np.searchsorted(quotes, places) + (state != OUTSIDE)) % 2 == 1
    places = places[~inside]
    ends_inside = (len(quotes) + (state != OUTSIDE)) % 2 == 1
    return places, _CHANGE[data[places]], (ESCAPED if escaped else INSIDE) if ends_inside else OUTSIDE


def _blocks(source: JoinedFile, start: int, end: int) -> Iterator[np.ndarray]:
    source.seek(start)
    while start < end:
        data = source.read(min(BLOCK, end - start))
        if not data:
            return
        start += len(data)
        yield np.frombuffer(data, np.uint8)


def summary(blocks: Iterator[np.ndarray]) -> list[tuple[int, int]]:
    """(state behind, change of depth) for every state before."""
    now = [(state, 0) for state in (OUTSIDE, INSIDE, ESCAPED)]
    for data in blocks:
        told: dict[int, tuple[int, int]] = {}
        for state in {s for s, _ in now}:
            _, change, behind = _structure(data, state)
            told[state] = behind, int(change.sum())
        now = [(told[s][0], depth + told[s][1]) for s, depth in now]
    return now


def _elements(source: JoinedFile, start: int, end: int, state: int, depth: int) -> Iterator[bytes]:
    """Elements that begin in a range: behind the bracket that opens the array, or a comma at depth one."""
    open_, kept, at = False, [], start  # open_: an element of this range has begun
    for data in _blocks(source, start, source.size):
        places, change, state = _structure(data, state)
        after = depth + np.cumsum(change)
        # What opens the array or separates its elements, and what closes it.
        marks = np.flatnonzero((after == 1) & (change == 0) | (after == 1) & (change == 1) | (after == 0) & (change == -1))
        begin = 0
        for i in marks.tolist():
            place = int(places[i])
            if open_:
                kept.append(data[begin:place].tobytes())
                yield b"".join(kept)
                kept = []
            open_ = after[i] == 1 and at + place < end
            begin = place + 1
            if at + place >= end:
                return
        if open_:
            kept.append(data[begin:].tobytes())
        elif at + len(data) >= end:
            return
        depth, at = int(after[-1]) if len(after) else depth, at + len(data)
    if open_:
        raise NoJsonArray("the array does not end")


def read_json_array(spark: SparkSession, paths: Sequence[str], range_bytes: int = 16 << 20) -> DataFrame:
    """text: the elements of the JSON array that the files hold, one after the other, in any order.

    An empty array has no rows; what is not one whole array is an error.  Blank text between elements
    is dropped, the elements' own text stays as it is.
    """
    paths = list(paths)
    joined = JoinedFile(paths)
    size, whole = joined.size, io.BufferedReader(joined)
    range_bytes = max(range_bytes, -(-size // RANGES))
    starts = list(range(0, size, range_bytes))
    head = whole.read(1 << 16).lstrip(_BLANK)
    whole.seek(max(0, size - (1 << 16)))
    tail = whole.read(1 << 16).rstrip(_BLANK)
    if head[:1] != b"[" or tail[-1:] != b"]":
        raise NoJsonArray(f"{paths} do not hold one JSON array")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = JoinedFile(paths)
        for batch in batches:
            rows = [(s, *(v for pair in summary(_blocks(source, s, min(size, s + range_bytes))) for v in pair)) for s in batch.column("start").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_SUMMARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = JoinedFile(paths)
        for batch in batches:
            for row in batch.to_pylist():
                found, held = [], 0
                for raw in _elements(source, row["start"], min(size, row["start"] + range_bytes), row["state"], row["depth"]):
                    text = raw.strip(_BLANK)
                    if text:
                        found.append(text)
                        held += len(text)
                    if held >= BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], names=["text"])
                        found, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], names=["text"])

    def dealt(rows: list[tuple], schema: str) -> DataFrame:
        # A task per range.  Rows of an RDD have no size known to the planner.  That of a local table is, and as
        # the elements' size is estimated from it, joins took elements of any size for small and broadcast them.
        return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), schema)

    told = dealt([(s,) for s in starts], "start bigint").mapInArrow(scan, ", ".join(f"{c} bigint" for c in _SUMMARY)).collect()  # RANGES rows at most
    state, depth, entered = OUTSIDE, 0, []
    for row in sorted(told):
        entered.append((row[0], state, depth))
        state, change = row[1 + 2 * state], row[2 + 2 * state]
        depth += change
    if state != OUTSIDE or depth != 0:
        raise NoJsonArray(f"{paths} end inside a string or at depth {depth}")
    return dealt(entered, "start bigint, state int, depth bigint").mapInArrow(cut, "text string")


_SUMMARY = ["start", *(f"{what}{s}" for s in (OUTSIDE, INSIDE, ESCAPED) for what in ("state", "change"))]
