"""Global positions without a global sort: ordinals, seeded shuffle, holdout splits, mixtures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.interim import written

#: Rows that one bucket of an order should hold.
BUCKET_ROWS = 1_000_000


def _shifted(ranked: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Position: the 0-based ``_rank`` inside a row's bucket and the sizes of the buckets before."""
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    # A count per bucket, and a bucket holds up to BUCKET_ROWS rows.
    return ranked.join(F.broadcast(bases), "_bucket").withColumn(name, F.col("_base") + F.col("_rank")).drop("_bucket", "_base", "_rank")


def _placed(dealt: DataFrame, order: Sequence[Column | str], name: str, label: str, *spare: str) -> tuple[DataFrame, int]:
    """0-based position where tasks hold ranges of ``order`` that follow one another, and how many rows there are.

    Rows are sorted and written once, without the ``spare`` columns; a position is then two small numbers of a row.
    """
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the lower bits count a task's rows
    ranked = dealt.sortWithinPartitions(*order).withColumns({"_bucket": F.spark_partition_id(), "_rank": inside})
    held = written(ranked.drop(*spare), label)
    return _shifted(held, held.groupBy("_bucket").agg(F.count("*").alias("_n")), name), held.count()


def numbered(df: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """0-based position by ``keys``, and how many rows there are; see :func:`ordinal_by`."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    return _placed(df.repartitionByRange(*order), order, name, "ordinal")


def ordinal_by(df: DataFrame, key: str | Sequence[str], name: str = "pos") -> DataFrame:
    """0-based position by ``key``, a column or several; null keys come last, equal keys in any order.

    Tasks hold ranges of the key whose bounds are sampled, so neither gaps nor outliers of the key
    fill one of them; a row's rank is its place in its task.
    """
    return numbered(df, [key] if isinstance(key, str) else key, name)[0]


#: Steps of a permutation, and times it is repeated at most until it falls inside.
STEPS, WALKS = 8, 64


def _grid(n: int) -> tuple[int, int]:
    wide = math.isqrt(max(n, 1) - 1) + 1
    return wide, -(-max(n, 1) // wide)


@lru_cache(maxsize=16)
def _shifts(n: int, seed: str) -> list[np.ndarray]:
    """For every step what it adds to one coordinate, by the other: STEPS arrays of about the square root of n."""
    out = []
    for k in range(STEPS):
        side, others = _grid(n) if k % 2 == 0 else _grid(n)[::-1]
        digests = (hashlib.md5(f"{other}|{k}|{seed}".encode()).hexdigest() for other in range(others))
        out.append(np.fromiter((int(x[:15], 16) % side for x in digests), np.int64, others))
    return out


def _taken(at: np.ndarray, n: int, seed: str) -> np.ndarray:
    """Where the bijection takes numbers of 0 .. n-1."""
    wide, high = _grid(n)

    def once(i: np.ndarray) -> np.ndarray:
        x, y = i % wide, i // wide
        for k, shift in enumerate(_shifts(n, seed)):
            if k % 2 == 0:
                x = (x + shift[y]) % wide
            else:
                y = (y + shift[x]) % high
        return x + y * wide

    to = once(at)
    for _ in range(WALKS):
        outside = np.flatnonzero(to >= n)
        if not len(outside):
            return to
        to[outside] = once(to[outside])
    if (to >= n).any():
        raise ValueError(f"no place among {n} found")
    return to


def permuted(df: DataFrame, at: Column, n: int, seed: str, name: str) -> DataFrame:
    """``df`` with column ``name``: where a seeded bijection of 0 .. n-1 takes ``at``.

    A Feistel network on a grid of about the square root of n: row and column are shifted in turn by a
    digest of the other, which can be undone, so no two numbers meet.  The grid has up to a row more
    than n places; who lands there walks on until they are inside, which few need to.  Plain
    arithmetic on a row's own number: nothing is ranked, shuffled or joined.

    As a row or column has but the square root of n values, a worker takes their digests once, and a
    row costs eight look-ups instead of eight digests.
    """
    taken = F.pandas_udf(lambda i: pd.Series(_taken(i.to_numpy(np.int64), n, seed)), "bigint")
    # Not deterministic by name alone: filters on the new column are not written into its computation, which would then be done twice.
    return df.withColumn(name, taken.asNondeterministic()(at.cast("bigint")))


def seeded(seed: int, *keys: Column | str) -> Column:
    """Digest that orders rows at random but the same on every run and any partitioning."""
    columns = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *columns, F.lit(str(seed))).cast("binary"))


def counted_shuffle(df: DataFrame, keys: Sequence[str], seed: int, name: str = "pos") -> tuple[DataFrame, int]:
    """Position in a seeded shuffle of rows with unique ``keys``, and how many rows there are.

    As digests are spread evenly, a task takes an equal range of them: nothing is sampled or counted
    before, so ``df`` is computed once, moved once and written once, in order.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    digested = df.withColumn("_digest", F.unhex(seeded(seed, *keys)))
    first = F.conv(F.hex(F.substring("_digest", 1, 4)), 16, 10).cast("bigint")
    dealt = digested.repartitionById(tasks, F.shiftright(first * tasks, 32).cast("int"))
    return _placed(dealt, ["_digest", *keys], name, "shuffled", "_digest")


def shuffled(df: DataFrame, keys: Sequence[str], seed: int, name: str = "pos") -> DataFrame:
    """Position in a seeded shuffle of rows with unique ``keys``; see :func:`counted_shuffle`."""
    return counted_shuffle(df, keys, seed, name)[0]


def shuffled_like_pandas(df: DataFrame, position: str, seed: int, name: str = "pos") -> DataFrame:
    """Position under the legacy generator's permutation of row positions.

    The permutation is drawn on the driver, so this is for tables whose row numbers fit there.
    """
    order = np.random.RandomState(seed).permutation(df.count())
    schema = T.StructType([T.StructField(position, T.LongType()), T.StructField(name, T.LongType())])
    return df.join(df.sparkSession.createDataFrame([(int(r), i) for i, r in enumerate(order)], schema), position)


def holdout_size(n: int, fraction: float) -> int:
    return max(1, int(n * fraction))


def split_holdout(positioned: DataFrame, fraction: float = 0.01, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(train, holdout): the first positions are held out."""
    n = holdout_size(positioned.count(), fraction)
    return positioned.where(F.col(pos) >= n), positioned.where(F.col(pos) < n)


#: Hex digits of a group's digest that one step of the search for the split decides: up to 4,096 sums.
DIGITS = 3


def _group_digest(group: Sequence[str], seed: int) -> Column:
    """Digest of a group's name; its parts are told apart, and null from every text."""
    return seeded(seed, F.to_json(F.array(*[F.col(c).cast("string") for c in group])))


def split_groups(df: DataFrame, group: str | Sequence[str], fraction: float = 0.01, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, holdout) of whole groups: no group has rows in both.

    Groups are ordered by a seeded digest of their name and held out from the first on, until as many
    rows are held as :func:`split_holdout` would hold; the group at that number is held where that comes
    nearer to it, and one group is always held.  So the held rows miss the number by less than the
    group at the cut has, whatever the sizes of the groups.

    Rows are counted per group before anything is shuffled.  The place of the cut is found digit by digit
    in sums over the digests, so no order of groups is made, and each row then knows its side from its
    own digest: rows are neither joined nor moved.  Null is a group of its own; a table without rows gives
    two without rows; rows that repeat each other are on one side.
    """
    names = [group] if isinstance(group, str) else list(group)
    digest = _group_digest(names, seed)
    sizes = written(df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n")), "groups")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cut = _cut_digest(sizes, holdout_size(total, fraction))
    return df.where(digest > cut), df.where(digest <= cut)


def _cut_digest(sizes: DataFrame, wanted: int) -> str:
    """The last digest that is held, of groups (digest, n)."""
    prefix, before, last = "", 0, ""
    while True:
        inside = sizes.where(F.startswith("digest", F.lit(prefix))) if prefix else sizes
        part = F.substring("digest", 1, len(prefix) + DIGITS)
        sums = inside.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max("digest").alias("last")).orderBy("part").collect()
        for row in sums:
            if before + row["n"] < wanted:
                before, last = before + row["n"], row["last"]
                continue
            if row["groups"] > 1:
                prefix = row["part"]
                break
            # The group at the cut: with it too many are held or just enough, without it too few.
            return row["last"] if not before or before + row["n"] - wanted < wanted - before else last
        else:
            return last


def epoch_sizes(rows: Sequence[int], weights: Sequence[float]) -> list[int]:
    """Rows that each dataset gives to an epoch which holds the first one exactly once.

    The epoch's length follows from the first dataset's share; the others get their share of it,
    rounded half to even, and one row at least.
    """
    if not rows or len(rows) != len(weights):
        raise ValueError("a mixture takes one weight for each of its datasets, and at least one dataset")
    if any(n < 1 or not w > 0 for n, w in zip(rows, weights, strict=True)):
        raise ValueError("every dataset of a mixture has rows and a positive weight")
    share = np.asarray(weights, dtype=float) / float(sum(weights))
    length = np.rint(rows[0] / share[0])
    return [rows[0], *np.maximum(1, np.rint(length * share[1:])).astype(int).tolist()]


#: Repeats of one row that stay together where a child's rows are dealt out, and picks that a task then makes.
RUN, TASK_PICKS = 1_000, 250_000


def mixed_rows(children: Sequence[DataFrame], keys: Sequence[str], weights: Sequence[float], seed: int = 0) -> DataFrame:
    """Rows of the children in the mixture's order: their columns, child, pick and pos.

    Each child's rows are permuted, repeated or cut to its count, and all are interleaved.  A child is
    written once, numbered by its ``keys``, and goes on as in :func:`mixed_numbered`.
    """
    return mixed_numbered([numbered(c, keys, "_nth") if w > 0 else None for c, w in zip(children, weights, strict=True)], weights, seed)


def mixed_numbered(children: Sequence[tuple[DataFrame, int] | None], weights: Sequence[float], seed: int = 0, number: str = "_nth") -> DataFrame:
    """:func:`mixed_rows` of children whose rows are numbered: each with how many rows it has, ``number`` from 0.

    Picks and positions are arithmetic on the number (:func:`permuted`), so nothing is ranked, sorted or
    joined and rows keep their columns on the way.  Only a child that is repeated is moved, before it grows.
    A child of no weight is left out.
    """
    used = [(i, *c, w) for i, (c, w) in enumerate(zip(children, weights, strict=True)) if w > 0]
    counts = epoch_sizes([size for _, _, size, _ in used], [w for *_, w in used])
    parts, before, total = [], 0, sum(counts)
    for (i, rows, size, _), count in zip(used, counts, strict=True):
        rows = rows.withColumn("child", F.lit(i))
        if count > size:
            picked = _repeated(rows, number, size, count, f"{i}|{seed}")
            parts.append(permuted(picked, F.col("pick") + before, total, str(seed), "pos"))
        else:
            parts.append(_picked_once(rows, number, size, count, f"{i}|{seed}", before, total, str(seed)))
        before += count
    return reduce(DataFrame.unionByName, parts)


def _repeated(rows: DataFrame, number: str, size: int, count: int, seed: str) -> DataFrame:
    """Rows with their picks, of a child that gives more than it has.

    A small child may give most of a mixture, so its rows, in runs of their repeats, are dealt out to as many
    tasks as the picks need, not to those its own size would get.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // TASK_PICKS))
    last = F.floor((F.lit(count) - F.col("_first") - 1) / size)
    runs = permuted(rows, F.col(number), size, seed, "_first").drop(number)
    runs = runs.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(RUN).cast("bigint"))))
    again = runs.repartition(tasks, "_first", "_run").withColumn("_again", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + (RUN - 1), last))))
    return again.withColumn("pick", F.col("_first") + F.col("_again") * size).drop("_first", "_run", "_again")


def _picked_once(rows: DataFrame, number: str, size: int, count: int, seed: str, before: int, total: int, mixed_seed: str) -> DataFrame:
    """Rows with pick and pos, of a child that gives each row at most once: both in one visit to a worker."""

    def places(i: pa.Array) -> pa.Array:
        pick = _taken(i.to_numpy(zero_copy_only=False).astype(np.int64), size, seed)
        pos = np.full(len(pick), -1, np.int64)
        pos[pick < count] = _taken(pick[pick < count] + before, total, mixed_seed)
        return pa.StructArray.from_arrays([pa.array(pick), pa.array(pos)], ["pick", "pos"])

    # Not deterministic by name alone, as in permuted.
    place = F.arrow_udf(places, "struct<pick: bigint, pos: bigint>").asNondeterministic()
    placed = rows.withColumn("_place", place(F.col(number).cast("bigint"))).drop(number)
    return placed.withColumns({"pick": F.col("_place.pick"), "pos": F.col("_place.pos")}).where("pos >= 0").drop("_place")


def mix_index(children: Sequence[DataFrame], keys: Sequence[str], weights: Sequence[float], seed: int = 0) -> DataFrame:
    """pos, child, pick and the keys of the child's row."""
    return mixed_rows([c.select(*keys) for c in children], keys, weights, seed).select("pos", "child", *keys, "pick")


def batched(rows: DataFrame, length: Column, size: int, window: int = 256, ranks: int = 1, seed: int = 0, pos: str = "pos") -> DataFrame:
    """``rows`` with batch_id, rank and step: batches of ``size`` rows of like length, from their positions.

    Rows of ``window`` batches that follow one another are sorted by length, cut into batches, and the
    batches dealt in a seeded order, so that little is padded and no row moves further than its window.
    Every row is in one batch; batch b is the step b // ranks of rank b % ranks.  A window is a
    bounded group, and only whole ones before the last, so batch ids follow without counting.
    """
    group = F.floor(F.col(pos) / (size * window))
    df = rows.withColumns({"_window": group, "_length": length})
    by_length = Window.partitionBy("_window").orderBy("_length", pos)
    df = df.withColumn("_cut", F.floor((F.row_number().over(by_length) - 1) / size))
    digest = F.md5(F.concat_ws("|", F.col("_window").cast("string"), F.col("_cut").cast("string"), F.lit(str(seed))).cast("binary"))
    # The last batch of the last window may be short, and stays last.
    full = F.count("*").over(Window.partitionBy("_window", "_cut")) == size
    df = df.withColumns({"_digest": digest, "_full": full})
    nth = F.dense_rank().over(Window.partitionBy("_window").orderBy(F.desc("_full"), "_digest", "_cut")) - 1
    df = df.withColumn("batch_id", F.col("_window") * window + nth)
    df = df.withColumns({"rank": F.pmod("batch_id", F.lit(ranks)).cast("int"), "step": F.floor(F.col("batch_id") / ranks)})
    return df.drop("_window", "_length", "_cut", "_digest", "_full")
