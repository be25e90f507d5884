"""Packing of token sequences by non-negative least squares over a length histogram.

Every document gives whole windows and one remainder shorter than the window.  Only the histogram
of remainders (at most ``window - 1`` counts, whatever the corpus) reaches the driver.  There, all
shallow combinations of lengths that fill the window exactly are enumerated, their repeat counts
are fitted to the histogram by non-negative least squares until no count is more than half a
sequence from its optimum, rounded and taken as far as there are documents.  What is left is packed
greedily, largest first; where no length fits a gap of more than ``tolerance`` tokens, a longer
remainder is cut to fill it.

The plan says, for each remainder length, which ranks of its documents go to which sequence and
offset.  A document's rank is its place among documents of its length: counted inside each task
that wrote the encoded table, plus the counts of the tasks before, which lie in a file per task in
the shared folder.  No key gathers documents, so equal lengths and copies cost nothing, and token
ids are neither shuffled nor joined.

Defined results: a null text counts as empty, so its document is the end id alone; every id of
every row lies in exactly one piece; rows that repeat an id are packed one by one; an empty table
gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right, insort
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import forget, keep, new_path
from gridloom.llm.token_file import open_filesystem
from gridloom.llm.tokens import piece_encoder

@dataclass(frozen=True)
class Slot:
    """Documents of remainder ``root`` with ranks in [lo, hi) put ``length`` ids from ``start`` on
    into sequences base + (first + rank - lo) // per, at offset + (same % per) * length."""

    root: int
    lo: int
    hi: int
    start: int
    length: int
    base: int
    first: int
    per: int
    offset: int


@dataclass(frozen=True)
class Combinations:
    """Pattern p holds m[p] pieces of length a[p] and n[p] of length b[p]; n is 0 where a alone fills it."""

    a: np.ndarray
    m: np.ndarray
    b: np.ndarray
    n: np.ndarray

    def parts(self, p: int) -> list[tuple[int, int]]:
        return [(int(k), int(c)) for k, c in ((self.a[p], self.m[p]), (self.b[p], self.n[p])) if c]


def combinations(histogram: dict[int, int], window: int, parts: int = 8) -> Combinations:
    """All combinations of at most two lengths and ``parts`` pieces that fill the window exactly.

    They are no more than parts * parts / 2 for every length, and come in the order of how often
    the histogram could fill them.
    """
    there = np.zeros(window + 1, dtype=np.int64)
    for k, v in histogram.items():
        there[k] = v
    lengths = np.flatnonzero(there)
    found = []
    for m in range(1, parts + 1):
        rest = window - m * lengths
        whole = lengths[rest == 0]
        found.append(np.stack((whole, np.full(len(whole), m), whole, np.zeros(len(whole), np.int64)), axis=1))
        for n in range(1, parts - m + 1):
            b, odd = np.divmod(rest, n)
            fits = (rest > 0) & (odd == 0) & (b > lengths)
            fits[fits] = there[b[fits]] > 0
            found.append(np.stack((lengths[fits], np.full(fits.sum(), m), b[fits], np.full(fits.sum(), n)), axis=1))
    a, m, b, n = np.concatenate(found).T
    support = np.minimum(there[a] // m, np.where(n > 0, there[b] // np.maximum(n, 1), there[a]))
    order = np.lexsort((n, b, m, a, -support))
    order = order[support[order] > 0]
    return Combinations(a[order], m[order], b[order], n[order])


def fit(histogram: dict[int, int], patterns: Combinations, window: int) -> tuple[np.ndarray, float]:
    """Repeat counts x >= 0 that minimise |A x - h|^2, and how far the count farthest from its optimum is.

    Coordinate descent over the counts that are not yet settled, until none would move by more than
    half a sequence (or a millionth of the largest bar of the histogram, where that is more).
    """
    left = [0.0] * (window + 1)
    for k, v in histogram.items():
        left[k] = float(v)
    tolerance = max(0.5, 1e-6 * max(histogram.values(), default=0))
    a, m, b, n = patterns.a, patterns.m, patterns.b, patterns.n
    norms = (m * m + n * n).astype(float)
    x = [0.0] * len(a)
    columns = a.tolist(), m.tolist(), b.tolist(), n.tolist(), norms.tolist()
    while len(a):
        now, rest = np.array(x), np.array(left)
        steps = np.maximum((m * rest[a] + n * rest[b]) / norms, -now)
        unsettled = np.flatnonzero(np.abs(steps) > tolerance)
        if not len(unsettled):
            return now, float(np.abs(steps).max())
        for p in unsettled.tolist():
            i, mi, j, nj, norm = (c[p] for c in columns)
            new = max(0.0, x[p] + (mi * left[i] + nj * left[j]) / norm)
            step, x[p] = new - x[p], new
            left[i] -= mi * step
            left[j] -= nj * step
    return np.zeros(0), 0.0


class _Pool:
    """Remainders still to place: by length, runs of ranks of one root length."""

    def __init__(self, histogram: dict[int, int]):
        self.runs = {k: deque([(k, 0, n, 0)]) for k, n in histogram.items() if n}
        self.count = Counter({k: n for k, n in histogram.items() if n})
        self.lengths = sorted(self.runs)

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        self.count[length] -= n
        runs = self.runs[length]
        while n:
            root, lo, hi, start = runs.popleft()
            if hi - lo > n:
                runs.appendleft((root, lo + n, hi, start))
                hi = lo + n
            n -= hi - lo
            yield root, lo, hi, start
        if not runs:
            del self.runs[length], self.count[length]
            self.lengths.remove(length)

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        if length not in self.runs:
            self.runs[length] = deque()
            insort(self.lengths, length)
        self.runs[length].append(run)
        self.count[length] += run[2] - run[1]


def plan(histogram: dict[int, int], window: int, tolerance: int = 8) -> tuple[list[Slot], int]:
    """Slots for every remainder, and the number of sequences they fill."""
    pool, slots, n_sequences = _Pool(histogram), [], 0

    def place(parts: list[tuple[int, int]], times: int, cut: tuple[int, int] | None = None) -> None:
        nonlocal n_sequences
        offset = 0
        for length, per in parts:
            first = 0
            for root, lo, hi, start in pool.take(length, per * times):
                slots.append(Slot(root, lo, hi, start, length, n_sequences, first, per, offset))
                first += hi - lo
            offset += per * length
        if cut:
            whole, piece = cut
            first = 0
            for root, lo, hi, start in list(pool.take(whole, times)):
                slots.append(Slot(root, lo, hi, start, piece, n_sequences, first, 1, offset))
                pool.put(whole - piece, (root, lo, hi, start + piece))
                first += hi - lo
        n_sequences += times

    patterns = combinations(histogram, window)
    fitted, _ = fit(histogram, patterns, window)
    wanted = np.rint(fitted).astype(np.int64)
    for p in sorted(np.flatnonzero(wanted).tolist(), key=lambda p: (-wanted[p], p)):
        parts = patterns.parts(p)
        times = min(int(wanted[p]), *(pool.count.get(k, 0) // m for k, m in parts))
        if times:
            place(parts, times)
    while pool.lengths:
        left, parts = window, []
        used: Counter = Counter()
        while left:
            i = bisect_right(pool.lengths, left) - 1
            while i >= 0 and pool.count[pool.lengths[i]] <= used[pool.lengths[i]]:
                i -= 1
            if i < 0:
                break
            length = pool.lengths[i]
            per = min(left // length, pool.count[length] - used[length])
            parts.append((length, per))
            used[length] += per
            left -= per * length
        cut = None
        if left > tolerance:
            for length in reversed(pool.lengths):
                if length > left and pool.count[length] > used[length]:
                    cut = (length, left)
                    break
        need = Counter(used)
        if cut:
            need[cut[0]] += 1
        times = min(pool.count[k] // m for k, m in need.items())
        place(parts, times, cut)
    return slots, n_sequences


ENCODED = "doc_id {id}, shard int, n_tokens bigint, rest int, rank bigint, blocks bigint, ids binary"


def encode(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_column: str, text_column: str) -> DataFrame:
    """Ids of every row with their place among the rows of the same task; written once and read back."""
    df = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    end = struct.pack("<I", end_id)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = piece_encoder(tokenizer), TaskContext.get().partitionId()
        ranks: Counter = Counter()
        blocks = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                cols: list[list] = [[], [], [], [], [], []]
                for ids in encoder.encode(rows.column(1).to_pylist()):
                    raw = ids + end
                    n = len(raw) // 4
                    rest = n % window
                    for c, v in zip(cols, (shard, n, rest, ranks[rest], blocks, raw), strict=True):
                        c.append(v)
                    ranks[rest] += 1
                    blocks += n // window
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                    names=["doc_id", "shard", "n_tokens", "rest", "rank", "blocks", "ids"],
                )

    return keep(df.mapInArrow(run, ENCODED.format(id=kind)), "encoded")


def _slots_by_root(slots: list[Slot]) -> dict[int, list[tuple]]:
    """(lo, hi, start, length, base, first, per, offset) by remainder length; bounded by the window, not by the corpus."""
    out: dict[int, list[tuple]] = {}
    for s in slots:
        out.setdefault(s.root, []).append((s.lo, s.hi, s.start, s.length, s.base, s.first, s.per, s.offset))
    return out


def _write_bases(counts: DataFrame, window: int, n_sequences: int) -> str:
    """A file per shard: by remainder length the documents of it in the shards before, and last the
    sequence of the shard's first whole window.  Returns the folder."""
    root = new_path(counts.sparkSession, "ranks")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select(
        "shard", "rest", F.coalesce(F.sum("n").over(before.partitionBy("rest").orderBy("shard")), F.lit(0)).alias("base")
    )
    blocks = counts.groupBy("shard").agg(F.sum("blocks").alias("n"))
    blocks = blocks.select(
        "shard", (F.lit(n_sequences) + F.coalesce(F.sum("n").over(before.partitionBy(F.lit(0)).orderBy("shard")), F.lit(0))).alias("block_base")
    )
    shards = ranked.groupBy("shard").agg(F.collect_list("rest").alias("rests"), F.collect_list("base").alias("bases")).join(blocks, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_filesystem(root)
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                table = np.zeros(window + 1, dtype="<i8")
                table[row["rests"]] = row["bases"]
                table[window] = row["block_base"]
                own = f"{folder}/.{row['shard']}-{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(table.tobytes())
                fs.move(own, f"{folder}/{row['shard']}")
            yield batch.select(["shard"])

    shards.select("shard", "rests", "bases", "block_base").mapInArrow(run, "shard int").count()
    return root


def pack(
    docs: DataFrame,
    window: int = 4096,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    tolerance: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids."""
    encoded = encode(docs, tokenizer, end_id, window, id_column, text_column)
    whole = F.floor(F.col("n_tokens") / window)
    counts = keep(encoded.groupBy("shard", "rest").agg(F.count("*").alias("n"), F.sum(whole).alias("blocks")), "lengths", 12)
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    slots, n_sequences = plan(histogram, window, tolerance)
    by_root = _slots_by_root(slots)
    root = _write_bases(counts, window, n_sequences)
    forget(counts)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_filesystem(root)

        @lru_cache(maxsize=16)
        def bases(shard: int) -> list[int]:
            with fs.open_input_file(f"{folder}/{shard}") as file:
                return np.frombuffer(file.read(), dtype="<i8").tolist()

        for batch in batches:
            source, cols, raws = [], [[] for _ in names], []
            columns = (batch.column(c).to_pylist() for c in ("shard", "rest", "rank", "blocks", "ids"))
            for i, (shard, rest, rank, blocks, ids) in enumerate(zip(*columns, strict=True)):
                before, n = bases(shard), len(ids) // 4
                first, block, at = n // window, before[window] + blocks, before[rest] + rank
                found = [(k * window, window, block + k, 0) for k in range(first)]
                for lo, hi, start, length, base, offset_rank, per, offset in by_root.get(rest, ()):
                    if lo <= at < hi:
                        row, nth = divmod(offset_rank + at - lo, per)
                        found.append((first * window + start, length, base + row, offset + nth * length))
                for start, length, sequence, offset in found:
                    raw = ids[4 * start : 4 * (start + length)]
                    source.append(i)
                    if with_ids:
                        raws.append(raw)
                    for c, v in zip(cols, (start, length, zlib.crc32(raw), n, sequence, offset), strict=True):
                        c.append(v)
            out = [batch.column("doc_id").take(pa.array(np.array(source, dtype=np.int64))), *(pa.array(c, pa.int64()) for c in cols)]
            if with_ids:
                out.append(pa.array(raws, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *names, *["ids"] * with_ids])

    used = encoded.select("doc_id", "shard", "rest", "rank", "blocks", "ids")
    pieces = used.mapInArrow(cut, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", ids binary" * with_ids)
    return pieces.withColumnRenamed("doc_id", id_column)
