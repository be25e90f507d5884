"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

A document is the set of its distinct five-word shingles.  Rows with equal sets form a class and
meet as one representative.  The forest holds the representatives in 32 orders (trees): a tree reads
the 128 minimum hashes of a signature from another place on, and its documents are sorted by what it
reads.  Documents that agree on a tree's first four hashes form a region; a pair with Jaccard
similarity 0.75 shares a region of some tree with probability 1 - (1 - 0.75^4)^32 > 0.99999.

Links are found in rounds; a pair inside one component is never looked at again.

1. Every document of a region with the region's least one: this joins most copies.
2. Neighbours in the sorted orders, which have the longest common prefixes, across components.  The
   sort goes as deep as it must to tell documents apart, so the depth adapts to each region.
3. Regions of up to ``region`` documents that still hold several components: each document with the
   one of another component whose signature agrees most, then all that are near on full sets.
4. Larger regions that are still apart are compared whole: those that share documents form a group,
   the group is cut into blocks of bounded size, and every two blocks are one unit of work, in which
   all pairs across components meet.  So the depth of a tree's sort costs no links in dense regions.

A unit gives no more links than it has documents, so the rows made follow documents, not pairs; the
comparisons in a group of n documents that are similar to none follow n**2 (round 4 alone).  Orders
are range-partitioned by what is sorted, so no region, however large, is one task in rounds 1 and 2.

Defined results: a null or empty text (or one without words) has an empty set and links with
nothing; rows with a null id are returned, kept and linked with nothing; rows that repeat an id
are one document in the graph; ties go to the least id; an empty table gives an empty result;
extra columns are ignored.  Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import forget, keep, spare_memory
from gridloom.llm.graph import components
from gridloom.llm.wordhash import RollingHash, hash_words, mixed

HASHES, DEPTH = 128, 4
TREES = HASHES // DEPTH
SORTED = 8  # hashes beyond the region's that the orders are sorted by, a byte of each
SALTS = 64  # tasks that a class of copies is dealt to
#: A block of a large group holds sets of so many bytes; a document counts for DOCUMENT_BYTES more.
BLOCK_BYTES, DOCUMENT_BYTES = 8 << 20, 2048


@dataclass(frozen=True)
class Similarity:
    words: int = 5
    percent: int = 75
    region: int = 256
    #: Least share of agreeing signature bytes for a pair to be confirmed; six deviations below 0.75.
    screen: float = 0.52


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's start (n + 1 places)."""
    hashes, starts = hash_words([t.lower() for t in texts])
    rolling = RollingHash(hashes)
    windows = rolling.windows(words) if len(hashes) >= words else np.zeros(0, np.uint64)
    sets, ends = [], [0]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= words:
            found = np.unique(windows[a : b - words + 1])
        elif b > a:  # the whole sequence; its length keeps it apart from full shingles
            found = rolling.ranges(np.array([a]), np.array([b])) ^ np.uint64(b - a)
        else:
            found = np.zeros(0, np.uint64)
        sets.append(found)
        ends.append(ends[-1] + len(found))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array(ends, dtype=np.int64)


_random = np.random.default_rng(20240229)
_MASKS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MULTIPLIERS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def signatures(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minimum hashes (documents x HASHES, 32 bits) of sets that are not empty."""
    out = np.empty((len(ends) - 1, HASHES), dtype=np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((flat ^ _MASKS[i]) * _MULTIPLIERS[i], ends[:-1]) >> np.uint64(32)
    return out


def tree_keys(signature: np.ndarray) -> np.ndarray:
    """One key per tree: its first DEPTH hashes, mixed with the tree's number."""
    key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(signature), TREES))
    for d in range(DEPTH):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, d::DEPTH].astype(np.uint64))
    return key


def _sketch(df: DataFrame, words: int) -> DataFrame:
    """id, n, h1, h2 (a 128-bit hash of the set), keys per tree, signature bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                flat, ends = shingle_sets([t.encode() for t in rows.column(1).to_pylist()], words)
                sizes = np.diff(ends)
                full = np.flatnonzero(sizes)
                cols = {"h1": np.zeros(len(sizes), np.int64), "h2": np.zeros(len(sizes), np.int64)}
                keys, raw = [None] * len(sizes), [None] * len(sizes)
                if len(full):
                    inner = np.concatenate((ends[:-1][full], ends[-1:]))
                    signature = signatures(flat, inner)
                    cols["h1"][full] = np.add.reduceat(mixed(flat), inner[:-1]).view(np.int64)
                    cols["h2"][full] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), inner[:-1]).view(np.int64)
                    all_keys, low = tree_keys(signature).view(np.int64), signature.astype(np.uint8)
                    for j, i in enumerate(full.tolist()):
                        keys[i], raw[i] = all_keys[j], low[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sizes), pa.array(cols["h1"]), pa.array(cols["h2"]), pa.array(keys, pa.list_(pa.int64())), pa.array(raw, pa.binary())],
                    names=["id", "n", "h1", "h2", "keys", "bytes"],
                )

    return df.mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>, bytes binary")


def _sets(df: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                flat, ends = shingle_sets([t.encode() for t in rows.column(1).to_pylist()], words)
                raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(raw, pa.binary())], names=["node", "members"])

    return df.mapInArrow(run, "node bigint, members binary")


def _screened(pairs: DataFrame, sketches: DataFrame, screen: float) -> DataFrame:
    """Pairs whose signatures agree on a share of ``screen`` of their bytes."""
    small = sketches.select("node", "bytes")
    both = pairs.join(small.select(F.col("node").alias("a"), F.col("bytes").alias("x")), "a").join(
        small.select(F.col("node").alias("b"), F.col("bytes").alias("y")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= screen))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b"
    )
    possible = 100 * F.least(F.octet_length("x"), F.octet_length("y")) >= percent * F.greatest(F.octet_length("x"), F.octet_length("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in ("x", "y"))
                shared = len(x) + len(y) - len(np.union1d(x, y))
                good[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.where(possible).select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


ROW = "key bigint, node bigint, before bigint, part int, rim int"


def _orders(nodes: DataFrame) -> DataFrame:
    """The forest: a row per document and region of two or more, in the order of all trees.

    ``before`` is the neighbour that precedes it in the region.  First and last rows of a task
    (``rim`` 1 and 2; 0 inside) are always given, since their region may go on in the next one.
    """
    tree = F.posexplode("keys").alias("tree", "key")
    deep = F.substring(F.concat("bytes", "bytes"), DEPTH * (F.col("tree") + 1) + 1, F.lit(SORTED))
    placed = nodes.select("node", "bytes", tree).select("key", deep.alias("deep"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True

        def rows(key, node, before, rim) -> pa.RecordBatch:
            n = len(key)
            none = pa.array(before, pa.int64(), mask=before < 0) if n else pa.array([], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), none, pa.array(np.full(n, part, np.int32)), pa.array(rim, pa.int32())], names=["key", "node", "before", "part", "rim"])

        nothing = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (np.asarray(batch.column(c), dtype=np.int64) for c in (0, 1))
            if held is not None:
                key, node = np.concatenate((held[0], key)), np.concatenate((held[1], node))
                before0 = held[2]
            else:
                before0 = -1
            same = key[1:] == key[:-1]
            before = np.concatenate(([before0], np.where(same, node[:-1], -1)))
            # The last row waits for the one after it.
            inside = np.concatenate((before[:-1] >= 0, [False]))[: len(key) - 1] | same
            rim = np.zeros(len(key) - 1, np.int32)
            if first and len(key) > 1:
                inside[0], rim[0], first = True, 1, False
            at = np.flatnonzero(inside)
            yield rows(key[at], node[at], before[at], rim[at])
            held = key[-1:], node[-1:], int(before[-1])
        if held is not None:
            yield rows(held[0], held[1], np.array([held[2]], np.int64), np.array([2], np.int32))
        else:
            yield rows(nothing, nothing, nothing, nothing.astype(np.int32))

    order = ["key", "deep", "node"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "node").mapInArrow(run, ROW)


def _near(rows: DataFrame, screen: float) -> DataFrame:
    """Documents of a region that are near one of another component: the nearest of those, and how near."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")  # so that the first of equals is the least
        node = np.asarray(table.column("node"))
        component = np.asarray(table.column("component"))
        raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
        other, agree = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        for i in range(len(node)):
            same = np.where(component == component[i], -1, np.count_nonzero(raw == raw[i], axis=1))
            j = int(same.argmax())
            other[i], agree[i] = node[j], same[j]
        near = pa.array(agree >= screen * HASHES)
        out = table.select(["key", "node", "component"]).append_column("other", pa.array(other)).append_column("agree", pa.array(agree))
        return out.filter(near)

    return rows.groupBy("key").applyInArrow(run, "key bigint, node bigint, component bigint, other bigint, agree bigint")


def _connected(rows: DataFrame, percent: int) -> DataFrame:
    """Links that join the components of a region wherever full sets allow it.

    Documents of components that are joined already are not compared, so a region gives fewer
    links than it has documents.
    """

    def run(table: pa.Table) -> pa.Table:
        node, label = np.asarray(table.column("node")), np.asarray(table.column("component")).copy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("members").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        a, b = [], []
        for i in range(len(node)):
            fits = 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
            others = np.flatnonzero((label != label[i]) & fits & (sizes > 0) & (np.arange(len(node)) > i))
            if not len(others) or not sizes[i]:
                continue
            flat = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            starts = np.cumsum(sizes[others]) - sizes[others]
            shared = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
            for j in others[100 * shared >= percent * (sizes[i] + sizes[others] - shared)].tolist():
                if label[j] != label[i]:
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key").applyInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def _blocks(rows: DataFrame, step) -> DataFrame:
    """key, i, j, block, node, component, members: every row once in each unit (i, j) of its block.

    Blocks follow the components, and two blocks inside one component form no unit.  ``step`` keeps the
    weights, which are added up inside ranges of the order and over the ranges before, so that no task
    sorts a whole group.  Only the weights are sorted; the sets join their blocks afterwards.
    """
    weight = F.octet_length("members") + DOCUMENT_BYTES
    order = ["key", "component", "node"]
    summed = rows.groupBy(*order).agg(F.sum(weight).alias("weight"))
    light = step(summed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "weights", 1)
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    inside = F.coalesce(F.sum("weight").over(so_far.partitionBy("key", "range").orderBy("component", "node")), none)
    earlier = F.coalesce(F.sum("all").over(so_far.partitionBy("key").orderBy("range")), none)
    bases = light.groupBy("key", "range").agg(F.sum("weight").alias("all")).withColumn("base", earlier).drop("all")
    place = F.floor((F.col("base") + F.col("inside")) / BLOCK_BYTES).cast("int")
    light = light.withColumn("inside", inside).join(bases, ["key", "range"]).withColumn("block", place).select(*order, "block")
    blocks = light.groupBy("key", "block").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    left = blocks.select("key", F.col("block").alias("i"), F.col("first").alias("first_i"), F.col("last").alias("last_i"))
    right = blocks.select("key", F.col("block").alias("j"), F.col("first").alias("first_j"), F.col("last").alias("last_j"))
    units = left.join(right, "key").where("i <= j AND least(first_i, first_j) <> greatest(last_i, last_j)").select("key", "i", "j")
    sides = units.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return sides.join(light, ["key", "block"]).join(rows.select("node", "members"), "node").select("key", "i", "j", "block", "node", "component", "members")


def _joined_blocks(rows: DataFrame, percent: int, screen: float) -> DataFrame:
    """Links that join the components of each unit of :func:`_blocks` wherever full sets allow it."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, label = np.asarray(table.column("node")), np.asarray(table.column("component")).copy()
        block = np.asarray(table.column("block"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("members").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.concatenate(sets)
        low = np.ascontiguousarray(signatures(flat, ends).astype(np.uint8).T)
        shingles, places = np.unique(flat, return_inverse=True)
        mine = np.zeros(len(shingles), dtype=np.uint8)
        a, b = [], []
        for x in np.flatnonzero(block == i).tolist():
            fits = (label != label[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
            fits &= block == j if i != j else np.arange(len(node)) > x
            others = np.flatnonzero(fits)
            if not len(others):
                continue
            near = (low[:, others] == low[:, x, None]).sum(axis=0, dtype=np.uint8)
            others = others[near >= screen * HASHES]
            if not len(others):
                continue
            own = places[ends[x] : ends[x + 1]]
            mine[own] = 1
            found = mine[np.concatenate([places[ends[y] : ends[y + 1]] for y in others.tolist()])]
            mine[own] = 0
            shared = np.add.reduceat(found, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            for y in others[100 * shared >= percent * (sizes[x] + sizes[others] - shared)].tolist():
                if label[y] != label[x]:
                    a.append(min(node[x], node[y]))
                    b.append(max(node[x], node[y]))
                    label[label == label[y]] = label[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def _mixed_regions(rows: DataFrame) -> DataFrame:
    """Regions (key, size, least node) that hold more than one component."""
    return (
        rows.groupBy("key")
        .agg(F.count("*").alias("size"), F.min("node").alias("leader"), F.min("component").alias("first"), F.max("component").alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("key", "size", "leader")
    )


def _classes(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, node of every row: the least id with its set; the rows of the nodes themselves)."""
    rows = sketches.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    full = rows.where("n > 0 AND id IS NOT NULL")
    copies = full.groupBy("h1", "h2", "n").agg(F.min("id").alias("node"), F.max("id").alias("last")).where("node < last").drop("last")
    # A class may hold a third of all rows: its least id goes to every part of it.
    everywhere = copies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    placed = rows.join(everywhere, ["h1", "h2", "n", "salt"], "left").withColumn("node", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("node", "id")))
    own = placed.where("id = node").dropDuplicates(["node", "h1", "h2"])
    return placed.select("id", "n", "node"), own.select("node", "keys", "bytes")


def near_duplicates(docs: DataFrame, how: Similarity | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row."""
    how = how or Similarity()
    done: list[DataFrame] = []

    def step(frame: DataFrame, label: str, shrink: int = 12) -> DataFrame:
        done.append(keep(frame, label, shrink))
        return done[-1]

    def pairs_of(frame: DataFrame, other: str) -> DataFrame:
        ends = F.least("node", other).alias("a"), F.greatest("node", other).alias("b")
        return frame.select(*ends).where("a < b").distinct()

    df = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sketches = keep(_sketch(df, how.words), "sketches", 4)
    members, own = _classes(sketches)
    nodes = step(own, "nodes", 6)

    orders = step(_orders(nodes), "orders")
    first, last = orders.where("rim = 1"), orders.where("rim = 2")
    # Neighbours on both sides of the rim between two tasks.
    across = last.select("key", F.col("node").alias("before"), (F.col("part") + 1).alias("part")).join(first.select("key", "part", "node"), ["key", "part"])
    neighbours = orders.where("before IS NOT NULL").select("before", "node").unionByName(across.select("before", "node"))
    sized = orders.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("end")).where("leader < end").select("key", "leader")
    rows = step(orders.select("key", "node").join(sized, "key"), "regions")
    met = rows.select("node").distinct().withColumnRenamed("node", "id")
    sets = step(_sets(df.join(met, "id").select("id", "text"), how.words), "sets", 4)

    # An id that stands for a class of its own and lies in another joins the two.
    twice = pairs_of(members.where("id <> node").join(nodes.select(F.col("node").alias("id")), "id", "left_semi"), "id")
    links = step(_confirmed(_screened(pairs_of(rows, "leader"), nodes, how.screen), sets, how.percent).unionByName(twice), "links")
    found = components(links)

    def in_components(frame: DataFrame, node: str, component: str) -> DataFrame:
        named = found.select(F.col("node").alias(node), F.col("component").alias(component))
        return frame.join(named, node, "left").withColumn(component, F.coalesce(component, node))

    def linked(more: DataFrame) -> None:
        """Takes new links in."""
        nonlocal links, found
        new = step(more, "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = components(links)

    apart = in_components(in_components(pairs_of(neighbours, "before"), "a", "component"), "b", "other").where("component <> other").select("a", "b")
    linked(_confirmed(_screened(apart, nodes, how.screen), sets, how.percent))

    known = in_components(rows.select("key", "node"), "node", "component")
    regions = step(_mixed_regions(known), "mixed")
    small = known.join(regions.where(F.col("size") <= how.region).select("key"), "key")
    near = step(_near(small.join(nodes.select("node", "bytes"), "node"), how.screen), "near")
    # Every document with its nearest of another component: this joins what hangs on a common original.
    nearest = near.groupBy("node").agg(F.max_by("other", F.struct("agree", -F.col("other"))).alias("other"))
    linked(_confirmed(pairs_of(nearest, "other"), sets, how.percent))
    # What is still apart is compared in full, region by region.
    open_ = in_components(near.select("key", "node"), "node", "component")
    still = open_.join(_mixed_regions(open_).select("key"), "key")
    linked(_connected(still.join(sets, "node"), how.percent))

    large = regions.where(F.col("size") > how.region).select("key")
    if not large.isEmpty():
        inside = step(in_components(rows.join(large, "key"), "node", "component"), "large")
        apart = step(inside.join(_mixed_regions(inside).select("key"), "key"), "apart")
        if not apart.isEmpty():
            groups = components(apart.select(F.col("leader").alias("a"), F.col("node").alias("b")).where("a < b").distinct())
            grouped = groups.select("node", F.col("component").alias("key")).join(apart.select("node", "component").distinct(), "node")
            whole = step(grouped.join(sets.where(F.octet_length("members") > 0).distinct(), "node"), "whole")
            linked(_joined_blocks(_blocks(whole, step), how.percent, how.screen))
    forget(*done)  # what follows reads the sketches and the components alone
    out = members.join(found.withColumnRenamed("component", "found"), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("found", "node", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, how: Similarity | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged: one of each group, the one of the least id.

    Rows are judged by id and text together: rows that repeat both are one document, rows of one id
    with unlike texts are two.  Null ids come after all others; rows without words stay.
    """
    key = F.xxhash64(F.col(id_column).cast("bigint"), F.coalesce(F.col(text_column), F.lit("")))
    judged = near_duplicates(docs.select(key.alias("_key"), F.col(text_column).alias("_text")), how, "_key", "_text")
    ids = docs.select(key.alias("_key"), F.col(id_column).cast("bigint").alias("_id")).distinct()
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_key"))
    groups = judged.select("_key", "component_id").distinct().join(ids, "_key")
    stay = groups.groupBy("component_id").agg(F.min_by("_key", order).alias("_key")).select("_key")
    # Rows that repeat an id and a text are alike, but for their other columns.
    one = Window.partitionBy("_key").orderBy(F.monotonically_increasing_id())
    kept = docs.withColumn("_key", key).join(stay, "_key", "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    return kept.select(*docs.columns)
