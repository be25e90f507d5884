"""Exact top-k search by inner product with vector-approximation files.

Components x count as the whole number floor(scale * x).  Vectors are dealt by a hash of their row
into blocks of bounded size, and of every block an approximation is written: an 8-bit cell per
component, and per dimension and cell the least and greatest value found in it.

1. Scan: every block of queries meets every group of blocks of cells, never an exact vector.  With
   the middle m and half width w of the cells, a score lies in q*m -/+ |q|*w, two matrix products.
   The k-th best lower bound rises from block to block, and of each group only vectors whose upper
   bound reaches it are passed on.
2. The k-th best lower bound over all blocks is a bar for each query; what lies below it is out.
3. Read: the exact vectors of the candidates with the greatest upper bounds are read first, and
   after them only those whose upper bound still reaches the k-th exact score found.

Of equal vectors the k + 1 of least id can be in a result, so copies beyond that are no candidates;
the others would rank after them for every query.  A unit's cost and memory depend on the block
sizes alone, and blocks are dealt by hash, so neither equal vectors nor labels make one larger.

Defined results: a vector takes part if it is not null and all its components are finite numbers of
whatever size; every row but the query's own row is a candidate, rows that repeat an id included; a
null id is no query, and as a candidate comes after other ids of equal score; vectors meet only
vectors of the same length, and those without components meet none; fewer candidates than k give
fewer rows; equal scores go to the smaller id; scores are ranked to 38 digits and, beyond 64 bits, shown
as the end of the 64-bit range;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import forget, keep

CELLS = 256
#: Sums of products below these are exact in floats and in doubles.
SMALL, EXACT = 1 << 23, 1 << 52
#: Queries whose bounds are held at once.
SLICE = 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Scores are ranked as decimals of 38 digits.
RANKED = 10**38 - 1


def taking_part(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """row, id, x (doubles), width, wide (large components, dealt apart) of the vectors that take part."""
    x = F.transform(vector_column, lambda v: v.cast("double"))
    df = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("bigint").alias("id"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    largest = F.array_max(F.transform("x", lambda v: F.abs(v)))
    return df.where((F.size("x") > 0) & fine).withColumns({"width": F.size("x"), "wide": largest >= float(1 << 12)})


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, exact for a scale that is a power of two; infinite beyond a double's range."""
    with np.errstate(over="ignore"):
        return np.floor(x * float(scale))


def approximate(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of every component, and per dimension and cell the least and greatest value in it."""
    n, width = codes.shape
    least, most = np.full((width, CELLS), np.inf), np.full((width, CELLS), -np.inf)
    cells = np.zeros((n, width), dtype=np.uint8)
    for d in range(width):
        column = codes[:, d]
        rims = np.linspace(column.min(), column.max(), CELLS + 1)[1:-1] if np.isfinite(column).all() else np.zeros(CELLS - 1)
        cells[:, d] = np.searchsorted(rims, column, side="right")
        np.minimum.at(least[d], cells[:, d], column)
        np.maximum.at(most[d], cells[:, d], column)
    return cells, least, most


def bounds(queries: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores, exact or rounded outwards."""
    column = np.arange(cells.shape[1])
    low, high = least[column, cells], most[column, cells]
    with np.errstate(over="ignore", invalid="ignore"):
        size = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * cells.shape[1]
        if size < SMALL / 2:
            queries, low, high = (v.astype(np.float32) for v in (queries, low, high))
        middle = queries @ (low + high).T
        if size < EXACT / 4 and np.array_equal(low, high):
            lower = upper = 0.5 * middle
        else:
            spread = np.abs(queries) @ (high - low).T
            lower, upper = 0.5 * (middle - spread), 0.5 * (middle + spread)
        if not size < EXACT / 4:
            slack = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T * (4 * cells.shape[1] * np.finfo(float).eps)
            lower, upper = lower - slack, upper + slack
            lower, upper = np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)
    return lower, upper


def exact_scores(a: np.ndarray, b: np.ndarray, starts: np.ndarray, scale: int) -> list[int]:
    """Inner products of the vectors that lie one after the other in ``a`` and ``b``."""
    x, y = whole_numbers(a, scale), whole_numbers(b, scale)
    with np.errstate(over="ignore", invalid="ignore"):
        sums = np.add.reduceat(x * y, starts)
        sizes = np.add.reduceat(np.abs(x) * np.abs(y), starts)
    out = sums.tolist()
    ends = np.append(starts[1:], len(a))
    for i in range(len(starts)):
        if sizes[i] < EXACT:
            out[i] = int(out[i])
        else:  # too large for doubles: whole numbers without a limit
            p, q = ([int(v) if np.isfinite(v) else int(u) * scale for u, v in zip(raw[starts[i] : ends[i]].tolist(), whole[starts[i] : ends[i]].tolist(), strict=True)] for raw, whole in ((a, x), (b, y)))
            out[i] = max(-RANKED, min(RANKED, sum(u * v for u, v in zip(p, q, strict=True))))
    return out


def _blocks(df: DataFrame, n_blocks: int, salt: int, scale: int, approximated: bool) -> DataFrame:
    """A row per block: its rows and either their cells with the values in them, or the vectors."""
    dealt = df.withColumn("block", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n_blocks)).cast("int"))
    names = ("rows", "cells", "least", "most") if approximated else ("rows", "x")
    schema = pa.schema([("width", pa.int32()), ("wide", pa.bool_()), ("block", pa.int32()), *((c, pa.binary()) for c in names)])

    def build(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        codes = whole_numbers(np.asarray(table.column("x").combine_chunks().flatten()).reshape(len(table), width), scale)
        out = {c: [table.column(c)[0].as_py()] for c in ("width", "wide", "block")}
        out["rows"] = [np.asarray(table.column("row"), dtype=np.int64).tobytes()]
        if approximated:
            cells, least, most = approximate(codes)
            out |= {"cells": [cells.tobytes()], "least": [least.tobytes()], "most": [most.tobytes()]}
        else:
            out["x"] = [codes.tobytes()]
        return pa.table(out, schema=schema)

    columns = ", ".join(f"{c} binary" for c in names)
    return dealt.select("width", "wide", "block", "row", "x").groupBy("width", "wide", "block").applyInArrow(build, f"width int, wide boolean, block int, {columns}")


def scan_group(blocks: list[tuple], query_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, row, lower, upper) arrays of what may be among the k best of all blocks (rows, cells, least, most)."""
    for at in range(0, len(queries), SLICE):
        mine, part = query_rows[at : at + SLICE], queries[at : at + SLICE]
        best = np.full((len(mine), k), -np.inf)  # the k best lower bounds so far
        found = []
        for rows, cells, least, most in blocks:
            lower, upper = bounds(part, cells, least, most)
            own = mine[:, None] == rows[None, :]
            if own.any():
                lower, upper = np.where(own, -np.inf, lower), np.where(own, -np.inf, upper)
            if len(rows) > k and not found:
                best = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k :].astype(float)
            else:
                better = lower > best.min(axis=1, keepdims=True)
                for i in np.flatnonzero(better.any(axis=1)).tolist():
                    best[i] = np.sort(np.append(best[i], lower[i, better[i]]))[-k:]
            q, r = np.nonzero((upper >= best.min(axis=1, keepdims=True)) & ~own)
            found.append((q, rows[r], lower[q, r].astype(float), upper[q, r].astype(float)))
        q, row, lower, upper = (np.concatenate(c) for c in zip(*found, strict=True))
        able = upper >= best.min(axis=1)[q]
        yield mine[q[able]], row[able], lower[able], upper[able]


def _scan(files: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, row, lower, upper of what may be among the k best of a group of blocks."""
    names, keys = ["query", "row", "lower", "upper"], ["width", "query_block", "part"]
    schema = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            width = left.column("width")[0].as_py()
            blocks = []
            for row in left.to_pylist():
                cells = np.frombuffer(row["cells"], dtype=np.uint8).reshape(-1, width)
                blocks.append((np.frombuffer(row["rows"], dtype=np.int64), cells, *(np.frombuffer(row[c]).reshape(width, CELLS) for c in ("least", "most"))))
            for row in right.to_pylist():
                asked = np.frombuffer(row["x"]).reshape(-1, width)
                out += scan_group(blocks, np.frombuffer(row["rows"], dtype=np.int64), asked, k)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names) if out else schema.empty_table()

    both = files.groupBy(*keys).cogroup(queries.groupBy(*keys))
    return both.applyInArrow(run, "query bigint, row bigint, lower double, upper double")


def _read(pairs: DataFrame, whole: DataFrame, asked: DataFrame, scale: int) -> DataFrame:
    """query, query_id, row, id, score of pairs, from their exact vectors."""
    both = pairs.select("query", "row").join(whole.select("row", "id", F.col("x").alias("a")), "row")
    both = both.join(asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("x").alias("b")), "query")
    kept = ["query", "query_id", "row", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column("a"), batch.column("b")
                lengths = np.asarray(pa.compute.list_value_length(a), dtype=np.int64)
                scores = exact_scores(np.asarray(a.flatten()), np.asarray(b.flatten()), np.cumsum(lengths) - lengths, scale)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([Decimal(v) for v in scores], pa.decimal128(38, 0))], names=[*kept, "score"])

    return both.select(*kept, "a", "b").mapInArrow(run, ", ".join(f"{c} bigint" for c in kept) + ", score decimal(38,0)")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    block_rows: int = 16384,
    part_blocks: int = 8,
    query_rows: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, id, score: the k best other vectors for every row with ``is_query``.

    ``is_query`` is a condition on the column ``id``; ``scale`` is a power of two.
    """
    whole = keep(taking_part(vectors, id_column, vector_column), "vectors", 6)
    asked = whole.where(F.col("id").isNotNull() & is_query)
    copies = F.row_number().over(Window.partitionBy("x").orderBy(F.col("id").asc_nulls_last(), "row"))
    candidates = whole.withColumn("_nth", copies).where(F.col("_nth") <= k + 1).drop("_nth")
    n_blocks, n_query_blocks = max(1, -(-whole.count() // block_rows)), max(1, -(-asked.count() // query_rows))
    files = keep(_blocks(candidates, n_blocks, 1, scale, True), "approximations", 6)
    n_parts = -(-n_blocks // part_blocks)
    files = files.withColumn("part", F.pmod("block", F.lit(n_parts)))
    queries = _blocks(asked, n_query_blocks, 2, scale, False).withColumnRenamed("block", "query_block")
    # Cells are the only part of the table that is copied: once for every block of queries.
    numbered = files.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    everywhere = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    scanned = keep(_scan(numbered, everywhere, k), "candidates", 6)
    by_query = Window.partitionBy("query")
    nth_lower = F.row_number().over(by_query.orderBy(F.desc("lower"), "row"))
    bars = scanned.withColumn("_n", nth_lower).where(F.col("_n") <= k).groupBy("query").agg(F.min("lower").alias("bar"), F.count("*").alias("_n"))
    bars = bars.select("query", F.when(F.col("_n") == k, F.col("bar")).otherwise(float("-inf")).alias("bar"))
    able = scanned.join(bars, "query").where("upper >= bar").select("query", "row", F.greatest("upper", F.lit(float(-RANKED))).alias("upper"))
    placed = keep(able.withColumn("nth", F.row_number().over(by_query.orderBy(F.desc("upper"), "row"))), "able", 6)
    first = keep(_read(placed.where(F.col("nth") <= 4 * k), whole, asked, scale), "read", 6)
    by_score = F.row_number().over(by_query.orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    certain = first.withColumn("_n", by_score).where(F.col("_n") == k).select("query", F.col("score").cast("double").alias("bar"))
    certain = certain.withColumn("bar", F.col("bar") - 1e-15 * F.abs("bar"))  # the cast may have rounded it up
    # A bound equal to the k-th score must still be read: equal scores go to the smaller id.
    open_ = placed.where(F.col("nth") > 4 * k).join(certain, "query").where("upper >= bar")
    ranked = first.unionByName(_read(open_, whole, asked, scale)).withColumn("rank", by_score).where(F.col("rank") <= k)
    score = F.greatest(F.least("score", F.lit(Decimal(MOST))), F.lit(Decimal(LEAST))).cast("bigint")
    out = keep(ranked.select("query_id", "rank", F.col("id").alias(id_column), score.alias("score")), "top", 6)
    forget(whole, files, scanned, placed, first)
    return out
