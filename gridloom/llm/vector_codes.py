"""Vector code compression: product codes whose nearest entries are found by vector-approximation files.

Components count as the whole number floor(scale * x); a vector is cut into equal parts, and the
codebook of a part position starts as that part of the vectors of least id.  Rounds assign every
part to its nearest entry and move every entry to the floored mean of its parts; a last assignment
gives the codes.

The search for the nearest entry is a VA-file filter.  Every coordinate of the entries is quantised
to a cell of a few bits, and of every cell the least and greatest coordinate in it are kept.  For
each part a lookup table holds, per coordinate and cell, the least and greatest squared distance
that an entry of the cell can have; sums over the coordinates are lower and upper bounds.  Entries
whose lower bound exceeds the least upper bound are out, and the others are refined with integer
distances.

Parts are assigned where their rows lie, in blocks of bounded size; a task sends on one row per
entry and block of rows with count and sums, which Spark adds up, and codebooks (parts * entries
rows) pass through the driver.  Integer sums do not depend on order, so reruns agree.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped; those
of another width than the kept vector of least id, or of a width that the parts do not divide, stay
without code and error and shape no codebook; fewer vectors than entries give fewer entries; equal
ids are ordered by their vectors and null ids come last; rows that repeat are coded one by one;
components beyond +/-2**32 count as that bound, distances are exact, and errors beyond 64 bits are
shown as the end of that range; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import keep

#: Rows whose bounds are held at once.
ROWS = 2048
#: Whole numbers are held to this bound; below SMALL all distances fit into 64 bits.
MOST_NUMBER, SMALL = 1 << 40, 1 << 24
MOST_LONG = (1 << 63) - 1
#: Labels whose errors are broadcast; more are joined by shuffle, each dealt to SALTS partitions.
BROADCAST_LABELS, SALTS = 100_000, 16


@dataclass(frozen=True)
class ProductCodes:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    #: Bits of a cell.
    bits: int = 4


class Approximation:
    """The cells of one part position's entries, and what is found in them."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries, n_cells = entries, 1 << bits
        n, width = entries.shape
        self.cells = np.zeros((n, width), dtype=np.intp)
        # An empty cell is never looked up.
        self.least, self.most = np.zeros((width, n_cells), dtype=entries.dtype), np.zeros((width, n_cells), dtype=entries.dtype)
        for d in range(width):
            column = entries[:, d]
            low, high = column.min(), column.max()
            self.cells[:, d] = ((column - low) * n_cells // (high - low + 1)).astype(np.intp)
            for c in np.unique(self.cells[:, d]):
                inside = column[self.cells[:, d] == c]
                self.least[d, c], self.most[d, c] = inside.min(), inside.max()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry to each row, ties to the lower index; how many were refined."""
        lower, upper = np.zeros((len(x), len(self.entries)), dtype=x.dtype), np.zeros((len(x), len(self.entries)), dtype=x.dtype)
        for d in range(x.shape[1]):
            below, above = self.least[d] - x[:, d, None], x[:, d, None] - self.most[d]
            near = np.maximum(np.maximum(below, above), 0)  # outside the cell's range, on one side
            far = np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, self.cells[:, d]]
            upper += (far * far)[:, self.cells[:, d]]
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        gap = x[row] - self.entries[entry]
        distance = (gap * gap).sum(axis=1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))  # every row has a candidate
        best = np.minimum.reduceat(distance, starts) if len(starts) else distance
        is_best = np.flatnonzero(distance == best[row])
        first = is_best[np.flatnonzero(np.diff(row[is_best], prepend=-1))]  # entries ascend within a row
        return entry[first], best, len(row)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, held to MOST_NUMBER."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * float(scale)), -MOST_NUMBER, MOST_NUMBER).astype(np.int64)


def _taking_part(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """id, label, x (doubles) of the vectors that are kept."""
    x = F.transform(vector_column, lambda v: v.cast("double"))
    df = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), x.alias("x"))
    return df.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))


def first_codebooks(kept: DataFrame, how: ProductCodes) -> list[np.ndarray]:
    """Codebooks of the vectors of least id; how.entries rows reach the driver.  Empty without usable vectors."""
    least = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).select(F.size("x").alias("n")).collect()
    if not least or least[0]["n"] == 0 or least[0]["n"] % how.parts:
        return []
    rows = kept.where(F.size("x") == least[0]["n"]).orderBy(F.col("id").asc_nulls_last(), "x").limit(how.entries).select("x").collect()
    numbers = whole_numbers(np.array([r["x"] for r in rows], dtype=float), how.scale)
    return [np.ascontiguousarray(part) for part in np.split(numbers, how.parts, axis=1)]


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray], how: ProductCodes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch: row numbers, whole numbers, codes (rows, parts), squared distances (rows, parts).  Other widths are left out."""
    width = len(books) * books[0].shape[1] if books else -1
    vectors = batch.column("x")
    fits = np.flatnonzero(np.asarray(vectors.value_lengths()) == width)
    plain = [Approximation(b, how.bits) for b in books]
    exact = None
    for at in range(0, len(fits), ROWS):
        rows = fits[at : at + ROWS]
        x = whole_numbers(np.asarray(vectors.take(pa.array(rows)).flatten(), dtype=float).reshape(len(rows), width), how.scale)
        wide = max(np.abs(x).max(), max(np.abs(b).max() for b in books)) >= SMALL
        if wide and exact is None:  # numbers without a limit
            exact = [Approximation(b.astype(object), how.bits) for b in books]
        codes, errors = np.zeros((len(rows), len(books)), np.int64), np.zeros((len(rows), len(books)), object if wide else np.int64)
        for p, part in enumerate(np.split(x, len(books), axis=1)):
            codes[:, p], errors[:, p], _ = (exact if wide else plain)[p].nearest(part.astype(object) if wide else part)
        yield rows, x, codes, errors


def next_codebooks(kept: DataFrame, books: list[np.ndarray], how: ProductCodes) -> list[np.ndarray]:
    """Every entry as the floored mean of the parts nearest to it; unused entries stay."""
    part_width = books[0].shape[1]
    names = ["part", "entry", "n", *[f"s{d}" for d in range(part_width)]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((how.parts, len(books[0])), np.int64)
        # Up to MOST_NUMBER each: sums of some million rows fit, and are handed on before there are more.
        sums = np.zeros((how.parts, len(books[0]), part_width), np.int64)

        def told() -> pa.RecordBatch:
            part, entry = np.nonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (part, entry, n[part, entry], *sums[part, entry].T)], names=names)

        seen = 0
        for batch in batches:
            for rows, x, codes, _ in _assigned(batch, books, how):
                for p, values in enumerate(np.split(x, how.parts, axis=1)):
                    np.add.at(n[p], codes[:, p], 1)
                    np.add.at(sums[p], codes[:, p], values)
                seen += len(rows)
                if seen >= 1 << 22:
                    yield told()
                    n[:], sums[:], seen = 0, 0, 0
        yield told()

    told = kept.select("x").mapInArrow(partial, ", ".join(f"{c} bigint" for c in names))
    totals = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[3:]])
    out = [b.copy() for b in books]
    for row in totals.collect():  # a row per entry
        out[row["part"]][row["entry"]] = [int(row[c]) // row["n"] for c in names[3:]]
    return out


def fit_codebooks(kept: DataFrame, how: ProductCodes) -> list[np.ndarray]:
    books = first_codebooks(kept, how)
    for _ in range(how.rounds if books else 0):
        books = next_codebooks(kept, books, how)
    return books


def encode(kept: DataFrame, books: list[np.ndarray], how: ProductCodes) -> DataFrame:
    """id, label, code, error of every kept vector."""
    hexadecimal = np.array([f"{i:02x}" for i in range(how.entries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for rows, _, codes, errors in _assigned(batch, books, how):
                code[rows] = ["".join(r) for r in hexadecimal[codes]]
                error[rows] = [min(int(e), MOST_LONG) for e in errors.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def codebooks_digest(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(v) for book in books for entry in book.tolist() for v in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(vectors: DataFrame, how: ProductCodes | None = None, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per kept vector: code, error, the error of all vectors of its label, and the digest of the codebooks."""
    how = how or ProductCodes()
    if how.entries > 256:
        raise ValueError("codes have two hexadecimal digits a part, so 256 entries at most")
    kept = _taking_part(vectors, id_column, vector_column, label_column)
    books = fit_codebooks(kept, how)
    coded = keep(encode(kept, books, how), "codes")
    labels = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_total"))
    labels = labels.select("_label", F.when(F.col("_total") > MOST_LONG, MOST_LONG).otherwise(F.col("_total")).cast("bigint").alias("label_error"))
    if labels.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(labels), F.col("label").eqNullSafe(F.col("_label")), "left")
    else:
        salted = labels.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_copy")), "left")
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
